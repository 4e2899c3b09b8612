"""BED files in gzip blocks with a range index (BGZF and tabix, both published formats), as a Spark data source.

Writing: rows come sorted by chrom and start in range partitions, as a column of finished lines. Tasks write blocks of at most 64 KB
and note where runs of rows of one index bin begin and end; the commit shifts these by where each part comes to lie, writes one file and
its index beside it (see ``parts``).

Reading: ``spark.read.format("indexed_bed").schema(...).load(path)``. Partitions are ranges of the file between rows that the index
knows; filters on chrom, start and end choose ranges by the index, and only their blocks are read.

Coordinates beyond 2**29, which tabix can't name, take the wider published index (CSI, beside the file as .csi): option ``shift`` is the
bits of its smallest bins, of which there are five levels as in tabix. So an index has no more bins a chrom, however long it is.

Defined results: no rows make a file of the end mark and an index without names; null fields are empty; rows out of order and
coordinates beyond 2**(shift + 15), which the index can't name, are errors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bigwig import Wanted
from .parts import Parts, filesystem, stream

# Fixed values of the formats: the block at a file's end, a block's head without its size, the most bytes of text in a block, and the
# index's magic and layout (zero-based half-open ranges in columns 1 to 3, lines from # on are comments).
END_MARK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
TEXT = 0xFF00
INDEX_MAGIC, WIDE_MAGIC, INDEX_LAYOUT = b"TBI\x01", b"CSI\x01", (0x10000, 1, 2, 3, 35, 0)
#: Bits of the smallest bins, and of those of each level above.
SMALLEST, STEP, LEVELS, LARGEST = 14, 3, 5, 1 << 29
#: Compressed bytes of a partition, where the index has a row to cut at.
PIECE = 1 << 22


def block(text: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    return HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def shift_for(end: int) -> int:
    """Bits of the smallest bins for coordinates up to ``end``."""
    return max(SMALLEST, (max(end, 1) - 1).bit_length() - STEP * LEVELS)


def bins_of(start: np.ndarray, end: np.ndarray, smallest: int = SMALLEST) -> np.ndarray:
    """The smallest bin that holds each range whole."""
    out = np.zeros(len(start), np.int64)
    for level in range(LEVELS, 0, -1):  # from the finest level up, the coarser ones only where none was found
        shift = smallest + STEP * (LEVELS - level)
        first = ((1 << STEP * level) - 1) // 7
        here = (out == 0) & (start >> shift == (end - 1) >> shift)
        out[here] = first + (start[here] >> shift)
    return out


def bins_over(start: int, end: int, smallest: int = SMALLEST, levels: int = LEVELS) -> list[int]:
    """All bins that ranges overlapping this one can be in."""
    out = [0]
    for level in range(1, levels + 1):
        shift, first = smallest + STEP * (levels - level), ((1 << STEP * level) - 1) // 7
        out += range(first + (start >> shift), first + ((end - 1) >> shift) + 1)
    return out


def start_of(number: int, smallest: int = SMALLEST, levels: int = LEVELS) -> int:
    """Where a bin begins."""
    level = next(k for k in range(levels, -1, -1) if number >= ((1 << STEP * k) - 1) // 7)
    return number - ((1 << STEP * level) - 1) // 7 << smallest + STEP * (levels - level)


@dataclass
class Written(WriterCommitMessage):
    path: str
    size: int
    names: list
    runs: np.ndarray  # chrom (number in names), bin, where the run begins and ends
    windows: np.ndarray  # chrom, number of the smallest bin, its first row's place
    ends: tuple | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.parts, self.shift = options["path"], Parts(options["path"]), int(options.get("shift", SMALLEST))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        path, out = self.parts.open()
        text, size, names = bytearray(), 0, []
        runs: list[np.ndarray] = []
        windows: dict[tuple[int, int], int] = {}
        first = last = None

        def flush(all_of_it: bool) -> None:
            nonlocal size
            while len(text) >= TEXT or (all_of_it and text):
                made = block(bytes(text[:TEXT]))
                del text[:TEXT]
                out.write(made)
                size += len(made)

        for b in iterator:
            if not b.num_rows:
                continue
            chroms, lines = b.column("chrom").to_pylist(), b.column("line").to_pylist()
            start, end = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            if (start < 0).any() or (end < start).any() or (end > LARGEST << self.shift - SMALLEST).any():
                raise ValueError("a range is turned round, or beyond what the index can name")
            number, places = np.zeros(len(lines), np.int64), np.zeros(len(lines) + 1, np.int64)
            for k, (chrom, line) in enumerate(zip(chroms, lines)):
                if not names or names[-1] != chrom:
                    if names and chrom.encode() < names[-1].encode():
                        raise ValueError("rows aren't sorted by chrom and start")
                    names.append(chrom)
                number[k], places[k] = len(names) - 1, size << 16 | len(text)
                text += line.encode() + b"\n"
                flush(False)
            places[-1] = size << 16 | len(text)
            here = [(int(c), int(s)) for c, s in zip(number, start)]
            if any(a > c for a, c in zip([last or here[0], *here], here)):
                raise ValueError("rows aren't sorted by chrom and start")
            first, last = first or (names[0], int(start[0])), here[-1]
            high = np.maximum(end, start + 1)
            bins = bins_of(start, high, self.shift)
            turn = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (bins[1:] != bins[:-1])]))
            runs.append(np.column_stack([number[turn], bins[turn], places[turn], places[np.append(turn[1:], len(lines))]]))
            for c, low, top, place in zip(number.tolist(), (start >> self.shift).tolist(), ((high - 1) >> self.shift).tolist(), places.tolist()):
                for w in range(low, top + 1):
                    windows.setdefault((c, w), place)
        flush(True)
        out.close()
        w = np.array([(c, w, p) for (c, w), p in windows.items()], np.int64).reshape(-1, 3)
        return Written(path, size, names, np.concatenate(runs) if runs else np.zeros((0, 4), np.int64), w, (first, (names[last[0]], last[1])) if first else None)

    def commit(self, messages: list) -> None:
        key = lambda e: (e[0].encode(), e[1])
        done = sorted((m for m in messages if m is not None and m.ends), key=lambda m: key(m.ends[0]))
        for a, b in zip(done, done[1:]):
            if key(a.ends[1]) > key(b.ends[0]):
                self.parts.discard()
                raise ValueError("ranges of two tasks overlap; deal the rows out by ranges of chrom and start")
        endings = (".csi", ".tbi") if self.shift > SMALLEST else (".tbi", ".csi")
        index, other = (Parts(self.path + e) for e in endings)
        content = _index(done, self.shift)
        other.remove()  # of a file that was here before
        index.assemble([block(content[k : k + TEXT]) for k in range(0, len(content), TEXT)] + [END_MARK])
        self.parts.assemble([*(m.path for m in done), END_MARK])

    def abort(self, messages: list) -> None:
        self.parts.discard()


def _index(done: list[Written], shift: int = SMALLEST) -> bytes:
    """The index's content: of each chrom its bins with their runs, and the first place of each smallest bin (a wide index has it in the bins)."""
    names: list[str] = []
    chunks: list[dict[int, list[list[int]]]] = []
    first: list[dict[int, int]] = []
    base = 0
    for m in done:
        for n in m.names:
            if not names or names[-1] != n:
                names.append(n)
                chunks.append({})
                first.append({})
        known = len(names) - len(m.names)
        for c, b, begin, end in m.runs.tolist():
            begin, end, of = begin + (base << 16), end + (base << 16), chunks[known + c].setdefault(b, [])
            if of and of[-1][1] == begin:
                of[-1][1] = end
            else:
                of.append([begin, end])
        for c, w, place in m.windows.tolist():
            first[known + c].setdefault(w, place + (base << 16))
        base += m.size
    joined = b"".join(n.encode() + b"\0" for n in names)
    if wide := shift > SMALLEST:
        out = [WIDE_MAGIC, struct.pack("<3i6ii", shift, LEVELS, 28 + len(joined), *INDEX_LAYOUT, len(joined)), joined, struct.pack("<i", len(names))]
    else:
        out = [INDEX_MAGIC, struct.pack("<i6ii", len(names), *INDEX_LAYOUT, len(joined)), joined]
    for bins, starts in zip(chunks, first):
        linear, place = [], 0
        for w in range(max(starts, default=-1) + 1):  # an empty bin begins where the one before it does
            place = starts.get(w, place)
            linear.append(place)
        out.append(struct.pack("<i", len(bins)))
        for b in sorted(bins):
            at = struct.pack("<Q", linear[start_of(b, shift) >> shift]) if wide else b""
            out.append(struct.pack("<I", b) + at + struct.pack("<i", len(bins[b])) + b"".join(struct.pack("<QQ", *c) for c in bins[b]))
        if wide:
            continue
        out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
    return b"".join(out)


class Index:
    """A read index."""

    def __init__(self, path: str):
        raw, text = b"".join(stream(path)), []
        while raw:
            unpack = zlib.decompressobj(31)
            text.append(unpack.decompress(raw))
            raw = unpack.unused_data
        data = b"".join(text)
        if data[:4] not in (INDEX_MAGIC, WIDE_MAGIC):
            raise ValueError(f"{path} is no index")
        self.wide, self.shift, self.levels = data[:4] == WIDE_MAGIC, SMALLEST, LEVELS
        if self.wide:
            self.shift, self.levels, more = struct.unpack_from("<3i", data, 4)
            at, names = 16 + more, 16  # the layout comes before the number of chroms here
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
        else:
            (n,), names = struct.unpack_from("<i", data, 4), 8
            at = 36 + struct.unpack_from("<i", data, 32)[0]
        (length,) = struct.unpack_from("<i", data, names + 24)
        self.names = [x.decode() for x in data[names + 28 : names + 28 + length].split(b"\0")[:-1]]
        self.bins, self.linear = [], []  # linear: first places of smallest bins in order, or in a wide index, by bin
        for _ in range(n):
            bins, linear = {}, {}
            (count,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(count):
                (b,) = struct.unpack_from("<I", data, at)
                if self.wide:
                    (linear[b],) = struct.unpack_from("<Q", data, at + 4)
                    at += 8
                (chunks,) = struct.unpack_from("<i", data, at + 4)
                bins[b] = np.frombuffer(data, "<u8", 2 * chunks, at + 8).astype(np.int64).reshape(-1, 2)
                at += 8 + 16 * chunks
            if not self.wide:
                (count,) = struct.unpack_from("<i", data, at)
                linear = dict(enumerate(np.frombuffer(data, "<u8", count, at + 4).astype(np.int64).tolist()))
                at += 4 + 8 * count
            self.linear.append(linear)
            self.bins.append(bins)

    def least(self, linear: dict[int, int], low: int) -> int | None:
        """From where on rows reach ``low`` or lie beyond it; None where all end before it."""
        if not self.wide:
            return linear.get(low >> self.shift)
        b = ((1 << STEP * self.levels) - 1) // 7 + (low >> self.shift)
        while b and b not in linear:  # the bin before it, or where there is none, the one above
            up = (b - 1) >> STEP
            b = b - 1 if b > (up << STEP) + 1 else up
        return linear.get(b, 0)

    def ranges(self, wanted: Wanted) -> list[tuple[int, int]]:
        """Places in the file, from and to, that hold all that is wanted."""
        out = []
        for name, bins, linear in zip(self.names, self.bins, self.linear):
            if wanted.chroms is not None and name not in wanted.chroms:
                continue
            low, high = max(wanted.low, 0), min(wanted.high, 1 << self.shift + STEP * self.levels)
            if low >= high:
                continue
            # ends beyond low: from the row that first reaches low's bin; bins by number are few where the range is narrow
            numbers = bins.keys() if high - low > 1 << self.shift + 12 else bins.keys() & set(bins_over(low, high, self.shift, self.levels))
            least = self.least(linear, low)
            if least is None:
                continue
            # starts before high: up to the first row of a bin that begins there; rows lie in order of their starts
            most = min((int(of[0, 0]) for k, of in bins.items() if start_of(k, self.shift, self.levels) >= high), default=1 << 63)
            out += [(max(a, least), min(b, most)) for k in numbers for a, b in bins[k].tolist() if b > least and a < most]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def cut(self, ranges: list[tuple[int, int]], piece: int) -> list[tuple[int, int]]:
        """Long ranges in pieces of about ``piece`` compressed bytes, cut at rows."""
        rows = np.unique(np.array([place for of in self.linear for place in of.values()], np.int64))
        out = []
        for a, b in ranges:
            for r in rows[(rows > a) & (rows < b)].tolist():
                if (r >> 16) - (a >> 16) >= piece:
                    out.append((a, r))
                    a = r
            out.append((a, b))
        return out


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.piece, self.wanted, self.blocks = options["path"], int(options.get("piece", PIECE)), Wanted(), 0
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            self.wanted.narrow(f)
            yield f  # ranges hold other rows, too

    def partitions(self) -> list[InputPartition]:
        fs, inside = filesystem(self.path)
        wide = fs.get_file_info(f"{inside}.csi").type.name != "NotFound"
        index = Index(f"{self.path}.csi" if wide else f"{self.path}.tbi")
        return [Range(self.path, *r) for r in index.cut(index.ranges(self.wanted), self.piece)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            from pyarrow import csv

            types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
            text = b"".join(self._text(partition))
            if text:
                names = [n for n, _ in self.fields]
                kinds = {n: types[t] for n, t in self.fields}
                columns = max(len(names), text.split(b"\n", 1)[0].count(b"\t") + 1)
                read = csv.ReadOptions(column_names=names + [f"_{k}" for k in range(columns - len(names))])
                convert = csv.ConvertOptions(column_types=kinds, include_columns=names, strings_can_be_null=True, null_values=[""])
                yield from csv.read_csv(pa.BufferReader(text), read, csv.ParseOptions(delimiter="\t", quote_char=False), convert).to_batches()

    def _text(self, partition: Range) -> Iterator[bytes]:
        """The text of the range, block by block."""
        fs, inside = filesystem(partition.path)
        with fs.open_input_file(inside) as f:
            at, skip, (last, rest) = partition.begin >> 16, partition.begin & 0xFFFF, divmod(partition.end, 1 << 16)
            while at < last or (at == last and rest):
                f.seek(at)
                head = f.read(18)
                (size,) = struct.unpack("<H", head[16:18])
                text = zlib.decompress(f.read(size - 17)[:-8], -15)
                self.blocks += 1
                yield text[skip : rest if at == last else None]
                at, skip = at + size + 1, 0


class IndexedBed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_bed"

    def schema(self) -> str:
        return "chrom string, start bigint, end bigint"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))
