"""bigWig files as a Spark data source, in the published format.

Reading: ``spark.read.format("bigwig").load(path)`` gives chrom, start, end, value; with option ``table`` = "sizes" the header's chrom
and size. The driver walks only the upper nodes of the file's range tree; each partition is a run of its leaf nodes, read
and decoded by a task. Filters on chrom, start and end leave out nodes and blocks that can't match (Spark still applies them to rows).

Writing: rows sorted by chrom and start, in range partitions. Tasks write compressed blocks and the records of zoom levels; the commit
makes the trees from their bounds (see ``parts``). Option ``sizes`` is a JSON object of every chrom's size.

Coordinates in the format have 32 bits. A chrom longer than that is written in stretches of 2**31 bases, each a chrom of the file named by the chrom,
a tab and the stretch's number in five digits; reading puts them together again, in rows, sizes and filters. Other readers see the stretches.

Defined results: an interval over the border of two stretches comes back as one a stretch; chroms with a tab in their names are errors in the writer; values are single precision; an empty file or table has no rows and its chroms in the header; rows of chroms without a size,
beyond their chrom's end, overlapping or out of order are errors in the writer; other sections than the three of the format are errors."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .parts import Parts, files, filesystem

# Fixed values of the format.
MAGIC, TREE_MAGIC, CHROM_MAGIC, VERSION = 0x888FFC26, 0x2468ACE0, 0x78CA8C91, 4
HEADER, ZOOM_HEADER, SUMMARY, CHROM_HEADER, TREE_HEADER, SECTION = "IHHQQQHHQQIQ", "IIQQ", "Qdddd", "IIIIQQ", "IIQIIIIQII", "IIIIIBBH"
LEAF = [("c0", "u4"), ("s0", "u4"), ("c1", "u4"), ("s1", "u4"), ("offset", "u8"), ("size", "u8")]
ITEMS = {1: [("start", "u4"), ("end", "u4"), ("value", "f4")], 2: [("start", "u4"), ("value", "f4")], 3: [("value", "f4")]}
ZOOM = [("chrom", "u4"), ("start", "u4"), ("end", "u4"), ("n", "u4"), ("min", "f4"), ("max", "f4"), ("sum", "f4"), ("squares", "f4")]

#: Items in a block, entries in a tree's node, leaf nodes in a partition, rows in an Arrow batch.
BLOCK, NODE, LEAVES, ROWS = 1024, 256, 16, 1 << 16
#: Bases that a record of the first zoom level takes together; each further level takes four times as many.
FIRST_ZOOM, ZOOMS = 64, 10


#: The largest size of a chrom that is written whole, and the bases of a stretch of others.
LONGEST, STRETCH = (1 << 32) - 1, 1 << 31


@dataclass
class Stretch:
    """A chrom of a file: all of a chrom, or ``size`` bases of it from ``offset`` on."""

    chrom: str
    number: int
    offset: int
    size: int


def stretches(sizes: list[tuple[str, int]]) -> list[Stretch]:
    """The chroms of a file for these names and sizes, in order."""
    out: list[Stretch] = []
    for c, size in sizes:
        for offset in range(0, size, STRETCH) if size > LONGEST else (0,):
            out.append(Stretch(c, len(out), offset, min(STRETCH, size - offset) if size > LONGEST else size))
    return out


def layout(order: str, fields: list) -> np.dtype:
    return np.dtype([(n, order + t) for n, t in fields])


class File:
    """An open bigWig."""

    def __init__(self, path: str):
        fs, inside = filesystem(path)
        self.file = fs.open_input_file(inside)
        first = self.at(0, 4)
        self.order = next((o for o in "<>" if first == struct.pack(o + "I", MAGIC)), "")
        if not self.order:
            raise ValueError(f"{path} is no bigWig file")
        h = self.unpack(HEADER, 0)
        self.chrom_offset, self.index_offset, self.packed = h[3], h[5], h[10] > 0
        self.node_entries = self.unpack(TREE_HEADER, self.index_offset)[1]
        self.root = self.index_offset + struct.calcsize("<" + TREE_HEADER)

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def unpack(self, form: str, offset: int) -> tuple:
        return struct.unpack(self.order + form, self.at(offset, struct.calcsize("<" + form)))

    def chroms(self) -> dict[str, tuple[int, int]]:
        """Name to (number, size)."""
        _, _, key, _, _, _ = self.unpack(CHROM_HEADER, self.chrom_offset)
        out, left = {}, [self.chrom_offset + struct.calcsize("<" + CHROM_HEADER)]
        while left:
            node = left.pop()
            leaf, _, n = self.unpack("BBH", node)
            for k in range(n):
                place = node + 4 + k * (key + 8)
                name = self.at(place, key).rstrip(b"\0").decode()
                if leaf:
                    out[name] = self.unpack("II", place + key)
                else:
                    left.append(self.unpack("Q", place + key)[0])
        return out

    def stretches(self) -> list[Stretch]:
        """What chroms() gives, as stretches in the order of their numbers."""
        out = []
        for name, (number, size) in sorted(self.chroms().items(), key=lambda kv: kv[1][0]):
            cut = re.fullmatch(r"(.*)\t(\d{5})", name, re.DOTALL)
            out.append(Stretch(cut[1], number, int(cut[2]) * STRETCH, size) if cut else Stretch(name, number, 0, size))
        return out

    def node(self, offset: int) -> tuple[bool, np.ndarray]:
        leaf, _, n = self.unpack("BBH", offset)
        kind = layout(self.order, LEAF if leaf else LEAF[:-1])
        return bool(leaf), np.frombuffer(self.at(offset + 4, n * kind.itemsize), kind)

    def block(self, offset: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """chrom number, starts, ends, values."""
        raw = self.at(offset, size)
        raw = zlib.decompress(raw) if self.packed else raw
        chrom, first, _, step, span, kind, _, n = struct.unpack_from(self.order + SECTION, raw)
        if kind not in ITEMS:
            raise ValueError(f"section of unknown kind {kind}")
        x = np.frombuffer(raw, layout(self.order, ITEMS[kind]), n, struct.calcsize("<" + SECTION))
        start = x["start"].astype(np.int64) if kind < 3 else first + step * np.arange(n, dtype=np.int64)
        end = x["end"].astype(np.int64) if kind == 1 else start + span
        return chrom, start, end, x["value"].astype(np.float64)


@dataclass
class Wanted:
    """What the filters leave: chroms (None: all), ends beyond ``low`` and starts before ``high``."""

    chroms: frozenset | None = None
    low: int = -1
    high: int = 1 << 62

    def narrow(self, f) -> None:
        name = f.attribute[-1] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
        if name == "chrom" and isinstance(f, (EqualTo, In)):
            these = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.chroms = these if self.chroms is None else self.chroms & these
        elif name in ("start", "end") and not isinstance(f, In):
            v, at_end = int(f.value), name == "end"
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):  # an end exceeds its start
                self.low = max(self.low, v - (at_end and not isinstance(f, GreaterThan)))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, v + (not at_end and not isinstance(f, LessThan)))

    def of(self, entries: np.ndarray, known: list[Stretch]) -> np.ndarray:
        """Those entries of a node that can hold what is wanted."""
        c0, s0, c1, s1 = (entries[c].astype(np.int64) for c in ("c0", "s0", "c1", "s1"))
        if self.chroms is None and not any(x.offset for x in known):
            use = np.where(c0 == c1, (s0 < self.high) & (s1 > self.low), (c1 - c0 > 1) | (s0 < self.high) | (s1 > self.low))
        else:
            these = [x for x in known if (self.chroms is None or x.chrom in self.chroms) and x.offset < self.high and x.offset + x.size > self.low]
            c, offset = (np.array([getattr(x, name) for x in these], np.int64)[:, None] for name in ("number", "offset"))
            low, high = self.low - offset, self.high - offset
            use = (((c0 < c) | ((c0 == c) & (s0 < high))) & ((c1 > c) | ((c1 == c) & (s1 > low)))).any(0)
        return entries[use]


@dataclass
class Leaves(InputPartition):
    path: str
    offsets: list


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files(options["path"], ".bw", ".bigwig", ".bigWig")
        self.sizes, self.wanted, self.blocks = options.get("table") == "sizes", Wanted(), 0
        self.leaves = int(options.get("leaves", LEAVES))

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if not self.sizes:
                self.wanted.narrow(f)
            yield f  # blocks hold other rows, too

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            if self.sizes:
                out.append(Leaves(path, []))
                continue
            f = File(path)
            known, level = f.stretches(), [f.root]
            while level:
                nodes = [f.node(o) for o in level[:1]]
                if nodes[0][0]:
                    break
                level = [int(o) for at in level for o in self.wanted.of(f.node(at)[1], known)["offset"]]
            out += [Leaves(path, level[k : k + self.leaves]) for k in range(0, len(level), self.leaves)]
        return out or [Leaves("", [])]

    def read(self, partition: Leaves) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        f = File(partition.path)
        known = f.stretches()
        if self.sizes:
            sizes: dict[str, int] = {}
            for x in known:
                sizes[x.chrom] = max(sizes.get(x.chrom, 0), x.offset + x.size)
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["chrom", "size"])
            return
        names, numbers = pa.array([x.chrom for x in known], pa.string()), np.array([x.number for x in known], np.int64)
        held, rows = [], 0
        for offset in partition.offsets:
            for e in self.wanted.of(f.node(offset)[1], known):
                chrom, start, end, value = f.block(int(e["offset"]), int(e["size"]))
                self.blocks += 1
                at = int(np.searchsorted(numbers, chrom))
                held.append((np.full(len(start), at), start + known[at].offset, end + known[at].offset, value))
                rows += len(start)
                if rows >= ROWS:
                    yield self._batch(names, held)
                    held, rows = [], 0
        if held:
            yield self._batch(names, held)

    @staticmethod
    def _batch(names: pa.Array, held: list) -> pa.RecordBatch:
        chrom, start, end, value = map(np.concatenate, zip(*held))
        return pa.RecordBatch.from_arrays([names.take(pa.array(chrom)), pa.array(start), pa.array(end), pa.array(value)], ["chrom", "start", "end", "value"])


class Blocks:
    """A part file of compressed blocks, and their bounds."""

    def __init__(self, parts: Parts):
        self.path, self.out = parts.open()
        self.bounds: list[tuple] = []
        self.size = self.largest = 0

    def add(self, raw: bytes, bounds: tuple) -> None:
        packed = zlib.compress(raw)
        self.out.write(packed)
        self.bounds.append((*bounds, self.size, len(packed)))
        self.size, self.largest = self.size + len(packed), max(self.largest, len(raw))

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "bounds": np.array(self.bounds, layout("<", LEAF)), "size": self.size, "largest": self.largest}


class Zoom:
    """Records of ``width`` bases each, in blocks; the last record stays open until the next one begins."""

    def __init__(self, parts: Parts, width: int):
        self.blocks, self.width, self.n = Blocks(parts), width, 0
        self.open = self.full = np.zeros(0, layout("<", ZOOM))

    def add(self, x: np.ndarray) -> np.ndarray:
        """Take in finer records; the records that are done."""
        x = np.concatenate([self.open, x])
        window = x["start"] // self.width
        first = np.flatnonzero(np.concatenate([[True], (x["chrom"][1:] != x["chrom"][:-1]) | (window[1:] != window[:-1])])) if len(x) else np.zeros(0, int)
        out = x[first].copy()
        if len(x):
            out["end"] = np.maximum.reduceat(x["end"], first)
            for c, f in (("n", np.add), ("min", np.minimum), ("max", np.maximum), ("sum", np.add), ("squares", np.add)):
                out[c] = f.reduceat(x[c], first)
        done, self.open = out[:-1], out[-1:]
        self._keep(done)
        return done

    def _keep(self, done: np.ndarray, last: bool = False) -> None:
        self.n += len(done)
        self.full = np.concatenate([self.full, done])
        while len(self.full) >= BLOCK or (last and len(self.full)):
            part, self.full = self.full[:BLOCK], self.full[BLOCK:]
            self.blocks.add(part.tobytes(), (part["chrom"][0], part["start"][0], part["chrom"][-1], part["end"][-1]))

    def close(self) -> dict:
        self._keep(self.open, last=True)
        return self.blocks.close() | {"n": self.n}


@dataclass
class Written(WriterCommitMessage):
    data: dict
    zooms: list
    items: int
    summary: tuple
    ends: tuple | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        sizes = json.loads(options["sizes"])
        self.chroms = [(c, int(sizes[c])) for c in sorted(sizes, key=str.encode)]
        if any("\t" in c for c in sizes):
            raise ValueError("a chrom has a tab in its name")
        self.stretches = stretches(self.chroms)
        self.parts, self.value = Parts(options["path"]), options.get("value", "value")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names = pa.array([c for c, _ in self.chroms], pa.string())
        limit = np.array([s for _, s in self.chroms], np.int64)
        data, zooms = Blocks(self.parts), [Zoom(self.parts, FIRST_ZOOM << 2 * k) for k in range(ZOOMS)]
        held: list[np.ndarray] = []
        items, last, first, totals = 0, (-1, 0), None, [0, np.inf, -np.inf, 0.0, 0.0]
        kind = layout("<", [("chrom", "u4"), *ITEMS[1]])
        long = np.array([s > LONGEST for _, s in self.chroms], bool)
        number_of = {x.chrom: x.number for x in reversed(self.stretches)}  # of the first stretch
        base = np.array([number_of[c] for c, _ in self.chroms], np.int64)

        def put(x: np.ndarray) -> None:
            for at in np.split(x, np.flatnonzero(np.diff(x["chrom"])) + 1):  # a block has one chrom
                start, end = int(at["start"][0]), int(at["end"][-1])
                head = struct.pack("<" + SECTION, int(at["chrom"][0]), start, end, 0, 0, 1, 0, len(at))
                data.add(head + at[["start", "end", "value"]].astype(layout("<", ITEMS[1])).tobytes(), (at["chrom"][0], start, at["chrom"][0], end))
            z = np.zeros(len(x), layout("<", ZOOM))
            span, v = x["end"] - x["start"], x["value"].astype(float)
            z["chrom"], z["start"], z["end"], z["n"], z["min"], z["max"], z["sum"], z["squares"] = x["chrom"], x["start"], x["end"], span, v, v, v * span, v * v * span
            totals[0] += int(span.sum())
            totals[1], totals[2] = min(totals[1], float(v.min())), max(totals[2], float(v.max()))
            totals[3], totals[4] = totals[3] + float((v * span).sum()), totals[4] + float((v * v * span).sum())
            for zoom in zooms:
                z = zoom.add(z)

        for b in iterator:
            if not b.num_rows:
                continue
            number = pa.compute.index_in(b.column("chrom"), names)
            if number.null_count:
                raise ValueError("a chrom has no size")
            chrom, start, end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (number, b.column("start"), b.column("end")))
            if (start < 0).any() or (end <= start).any() or (end > limit[chrom]).any():
                raise ValueError("an interval is empty or lies beyond its chrom")
            before = np.concatenate([[last[0]], chrom[:-1]]), np.concatenate([[last[1]], end[:-1]])
            if ((chrom < before[0]) | ((chrom == before[0]) & (start < before[1]))).any():
                raise ValueError("intervals overlap or aren't sorted by chrom and start")
            first, last = first or (int(chrom[0]), int(start[0])), (int(chrom[-1]), int(end[-1]))
            value, at = b.column(self.value).to_numpy(zero_copy_only=False), np.arange(len(chrom))
            stretch = np.where(long[chrom], start // STRETCH, 0)
            over = np.where(long[chrom], (end - 1) // STRETCH, 0) - stretch
            if over.any():  # intervals over borders are cut
                at = np.repeat(at, over + 1)
                stretch = stretch[at] + np.arange(len(at)) - np.searchsorted(at, at)
            offset = stretch * STRETCH
            begin = np.maximum(start[at] - offset, 0)
            x = np.zeros(len(at), kind)
            x["chrom"], x["start"], x["value"] = base[chrom[at]] + stretch, begin, value[at]
            x["end"] = np.where(long[chrom[at]], np.minimum(end[at] - offset, STRETCH), end[at])
            items += len(x)
            held.append(x)
            if sum(map(len, held)) >= BLOCK:
                whole = np.concatenate(held)
                n = len(whole) // BLOCK * BLOCK
                for k in range(0, n, BLOCK):
                    put(whole[k : k + BLOCK])
                held = [whole[n:]]
        if sum(map(len, held)):
            put(np.concatenate(held))
        z = zooms[0].open  # no finer record follows: each level takes what is still open below
        for zoom in zooms[1:]:
            z = np.concatenate([zoom.add(z), zoom.open])
        return Written(data.close(), [z.close() for z in zooms], items, tuple(totals), (first, last) if first else None)

    def commit(self, messages: list) -> None:
        done = sorted((m for m in messages if m is not None and m.ends), key=lambda m: m.ends[0])
        for a, b in zip(done, done[1:]):
            if a.ends[1] > b.ends[0]:
                self.parts.discard()
                raise ValueError("intervals of two tasks overlap; deal the rows out by ranges of chrom and start")
        items = sum(m.items for m in done)
        levels = [k for k in range(ZOOMS) if 0 < 2 * sum(m.zooms[k]["n"] for m in done) <= items]
        cut = {x.chrom for x in self.stretches if x.offset}
        named = [(f"{x.chrom}\t{x.offset // STRETCH:05}" if x.chrom in cut else x.chrom, x.size) for x in self.stretches]
        self.parts.assemble(_file(named, done, levels))

    def abort(self, messages: list) -> None:
        self.parts.discard()


def tree(bounds: np.ndarray, at: int, end: int) -> bytes:
    """The range tree, header first, over blocks in order, to stand at byte ``at`` of the file; ``end`` is where the blocks end."""
    leaf, child = layout("<", LEAF), layout("<", LEAF[:-1])
    levels = [bounds]  # from the blocks up: the bounds of each level's nodes
    while len(levels) == 1 or len(levels[-1]) > 1:
        below, first = levels[-1], np.arange(0, max(1, len(levels[-1])), NODE)
        up = np.zeros(len(first), child)
        if len(below):
            last = np.minimum(first + NODE, len(below)) - 1
            up["c0"], up["s0"], up["c1"], up["s1"] = below["c0"][first], below["s0"][first], below["c1"][last], below["s1"][last]
        levels.append(up)
    place = at + struct.calcsize("<" + TREE_HEADER)
    for depth in range(len(levels) - 1, 0, -1):  # nodes stand in the file from the root down
        below = levels[depth - 1]
        count = np.diff(np.append(np.arange(0, max(1, len(below)), NODE), len(below)))
        size = 4 + count * (leaf if depth == 1 else child).itemsize
        levels[depth]["offset"] = place + np.cumsum(size) - size
        place += int(size.sum())
    root = levels[-1][0]
    out = [struct.pack("<" + TREE_HEADER, TREE_MAGIC, NODE, len(bounds), *(int(root[c]) for c in ("c0", "s0", "c1", "s1")), end, BLOCK, 0)]
    for depth in range(len(levels) - 1, 0, -1):
        below = levels[depth - 1]
        for k in range(0, max(1, len(below)), NODE):
            node = below[k : k + NODE]
            out += [struct.pack("<BBH", depth == 1, 0, len(node)), node.tobytes()]
    return b"".join(out)


def chrom_tree(chroms: list[tuple[str, int]], at: int) -> bytes:
    """Names in order to (number, size), as a tree of nodes of at most NODE items, to stand at byte ``at``."""
    key = max([1, *(len(c.encode()) for c, _ in chroms)])
    names = [c.encode().ljust(key, b"\0") for c, _ in chroms]
    levels = [[n + struct.pack("<II", k, s) for k, (n, (_, s)) in enumerate(zip(names, chroms))]]
    firsts = [names]
    while len(levels[-1]) > NODE:
        firsts.append(firsts[-1][::NODE])
        levels.append([b""] * len(firsts[-1]))
    place, out = at + struct.calcsize("<" + CHROM_HEADER), []
    for depth in range(len(levels) - 1, -1, -1):
        items = levels[depth]
        place += sum(4 + (key + 8) * len(items[k : k + NODE]) for k in range(0, max(1, len(items)), NODE))
        if depth:  # where the children's nodes will stand, one after another
            levels[depth] = items = [n + struct.pack("<Q", place + k * (4 + (key + 8) * NODE)) for k, n in enumerate(firsts[depth])]
        out += [struct.pack("<BBH", depth == 0, 0, len(items[k : k + NODE])) + b"".join(items[k : k + NODE]) for k in range(0, max(1, len(items)), NODE)]
    return struct.pack("<" + CHROM_HEADER, CHROM_MAGIC, min(NODE, max(1, len(chroms))), key, 8, len(chroms), 0) + b"".join(out)


def _joined(parts: list[dict], at: int) -> tuple[np.ndarray, int]:
    """The bounds of all parts' blocks, placed from byte ``at`` on, and where they end."""
    out = [np.zeros(0, layout("<", LEAF))]
    for p in parts:
        x = p["bounds"].copy()
        x["offset"] += np.uint64(at)
        out.append(x)
        at += p["size"]
    return np.concatenate(out), at


def _file(chroms: list, done: list[Written], levels: list[int]) -> Iterator[bytes | str]:
    """The file from front to back: bytes, and paths of parts."""
    size = lambda form: struct.calcsize("<" + form)
    summary_at = size(HEADER) + len(levels) * size(ZOOM_HEADER)
    chrom_at = summary_at + size(SUMMARY)
    names = chrom_tree(chroms, chrom_at)
    data_at = chrom_at + len(names)
    bounds, index_at = _joined([m.data for m in done], data_at + 8)
    index = tree(bounds, index_at, index_at)
    at, zooms = index_at + len(index), []
    for k in levels:
        parts = [m.zooms[k] for m in done]
        zoom_bounds, zoom_index_at = _joined(parts, at + 4)
        zoom_index = tree(zoom_bounds, zoom_index_at, zoom_index_at)
        zooms.append((FIRST_ZOOM << 2 * k, at, zoom_index_at, parts, zoom_index))
        at = zoom_index_at + len(zoom_index)
    largest = max([1, *(m.data["largest"] for m in done), *(z["largest"] for m in done for z in m.zooms)])
    yield struct.pack("<" + HEADER, MAGIC, VERSION, len(levels), chrom_at, data_at, index_at, 0, 0, 0, summary_at, largest, 0)
    for width, data, place, _, _ in zooms:
        yield struct.pack("<" + ZOOM_HEADER, width, 0, data, place)
    t = [m.summary for m in done]
    yield struct.pack("<" + SUMMARY, sum(x[0] for x in t), min([x[1] for x in t], default=0.0), max([x[2] for x in t], default=0.0), sum(x[3] for x in t), sum(x[4] for x in t))
    yield names
    yield struct.pack("<Q", len(bounds))
    yield from (m.data["path"] for m in done)
    yield index
    for _, _, _, parts, zoom_index in zooms:
        yield struct.pack("<I", sum(p["n"] for p in parts))
        yield from (p["path"] for p in parts)
        yield zoom_index


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, size bigint" if self.options.get("table") == "sizes" else "chrom string, start bigint, end bigint, value double"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))
