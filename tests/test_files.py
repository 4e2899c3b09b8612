"""File formats: bigWig, and BED in blocks with an index."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tidemark.sources import bgzf, bigwig, sinks, tracks


def small_file(path, order="<", packed=True):
    """A bigWig made here by hand: two chroms, one section of each kind, a tree of one leaf."""
    sections = [
        (0, 10, 30, struct.pack(order + "IIIIIBBH", 0, 10, 30, 0, 0, 1, 0, 2) + struct.pack(order + "IIfIIf", 10, 15, 1.5, 20, 30, -2.0)),
        (0, 40, 53, struct.pack(order + "IIIIIBBH", 0, 40, 53, 0, 3, 2, 0, 2) + struct.pack(order + "IfIf", 40, 4.0, 50, 5.0)),
        (1, 100, 122, struct.pack(order + "IIIIIBBH", 1, 100, 122, 10, 2, 3, 0, 3) + struct.pack(order + "fff", 7.0, 8.0, 9.0)),
    ]
    blocks = [zlib.compress(s[3]) if packed else s[3] for s in sections]
    chroms = struct.pack(order + "IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack(order + "BBH", 1, 0, 2) + b"".join(n + struct.pack(order + "II", k, s) for k, (n, s) in enumerate(((b"chrA", 1000), (b"chrB", 500))))
    data_at = 64 + len(chroms)
    index_at = data_at + 8 + sum(map(len, blocks))
    entries, at = b"", data_at + 8
    for (c, a, b, _), x in zip(sections, blocks):
        entries += struct.pack(order + "IIIIQQ", c, a, c, b, at, len(x))
        at += len(x)
    tree = struct.pack(order + "IIQIIIIQII", 0x2468ACE0, 4, 3, 0, 10, 1, 122, index_at, 1, 0) + struct.pack(order + "BBH", 1, 0, 3) + entries
    header = struct.pack(order + "IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 4096 if packed else 0, 0)
    path.write_bytes(header + chroms + struct.pack(order + "Q", 3) + b"".join(blocks) + tree)
    return str(path)


SMALL = [("chrA", 10, 15, 1.5), ("chrA", 20, 30, -2.0), ("chrA", 40, 43, 4.0), ("chrA", 50, 53, 5.0), ("chrB", 100, 102, 7.0), ("chrB", 110, 112, 8.0), ("chrB", 120, 122, 9.0)]


def rows(df):
    return sorted(map(tuple, df.select("chrom", "start", "end", "value").collect()))


@pytest.mark.parametrize("order, packed", [("<", True), ("<", False), (">", True)])
def test_bigwig_read(spark, tmp_path, order, packed):
    path = small_file(tmp_path / "a.bw", order, packed)
    x = tracks.bigwig(spark, path, "+")
    assert rows(x) == SMALL and {r["strand"] for r in x.collect()} == {"+"}
    assert sorted(map(tuple, tracks.bigwig_sizes(spark, path).collect())) == [("chrA", 1000), ("chrB", 500)]
    assert rows(x.where("chrom = 'chrA' and start >= 20 and end < 53")) == SMALL[1:3]
    # missing chroms and what lies outside are zeros
    asked = spark.createDataFrame([(0, "chrA", 5, 25), (1, "gone", 0, 4)], "id long, chrom string, start long, end long")
    got = {(r["id"], r["at"] if "at" in r.asDict() else r["pos"]): r["value"] for r in _raw(asked, x)}
    assert all(got[0, p] == (1.5 if 10 <= p < 15 else -2.0 if p >= 20 else 0) for p in range(5, 25)) and all(got[1, p] == 0 for p in range(4))


def _raw(asked, track):
    base = asked.select("id", "chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    t = track.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")
    return base.join(t, ["chrom", "pos"], "left").fillna(0.0, ["value"]).collect()


def test_bigwig_folder_and_bad_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for k in range(3):
        small_file(tmp_path / "many" / f"{k}.bw")
    (tmp_path / "many" / "notes.txt").write_text("no track")
    assert rows(tracks.bigwig(spark, str(tmp_path / "many"), "+")) == sorted(3 * SMALL)
    (tmp_path / "bad.bw").write_bytes(b"no bigWig file" * 20)
    with pytest.raises(Exception, match="no bigWig"):
        tracks.bigwig(spark, str(tmp_path / "bad.bw"), "+").count()


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """90,000 intervals in blocks of 16, nodes of 4, so that the trees are deep, written by several tasks."""
    path = str(tmp_path_factory.mktemp("bw") / "x.bw")
    df = spark.range(9000).selectExpr("concat('c', id % 3) chrom", "(id div 3) * 20 start", "(id div 3) * 20 + 5 + id % 15 end", "cast(id % 97 as double) / 4 value")
    sizes = spark.createDataFrame([(f"c{k}", 10**6 + k) for k in range(12)], "chrom string, size long")
    sinks.write_bigwig(df.unionByName(spark.createDataFrame([("c1", 10**6, 10**6 + 2, 1.0), ("other", 0, 1, 1.0), ("c2", 10**6 - 9, 10**6, None)], df.schema)), path, "value", sizes)
    return path, df, sizes


def test_bigwig_round_trip(spark, written):
    path, df, sizes = written
    assert rows(tracks.bigwig(spark, path, "-")) == rows(df)
    assert sorted(map(tuple, tracks.bigwig_sizes(spark, path).collect())) == sorted(map(tuple, sizes.collect()))
    x = tracks.bigwig(spark, path, "+", leaves=1)
    assert x.rdd.getNumPartitions() >= 1 and rows(x) == rows(df)


def test_bigwig_summary_and_zooms(written):
    path, df, _ = written
    f = bigwig.File(path)
    head = f.unpack(bigwig.HEADER, 0)
    want = df.agg(F.sum(F.col("end") - F.col("start")), F.min("value"), F.max("value"), F.sum(F.expr("value * (end - start)")), F.sum(F.expr("value * value * (end - start)"))).first()
    assert np.allclose(f.unpack(bigwig.SUMMARY, head[9]), list(want)) and head[2] >= 3
    widths = []
    for k in range(head[2]):
        width, _, data, index = f.unpack(bigwig.ZOOM_HEADER, 64 + 24 * k)
        widths.append(width)
        f.root = index + struct.calcsize("<" + bigwig.TREE_HEADER)
        leaves, left = [], [f.root]
        while left:
            leaf, e = f.node(left.pop(0))
            left, leaves = left + ([] if leaf else e["offset"].tolist()), leaves + (e.tolist() if leaf else [])
        z = np.concatenate([np.frombuffer(zlib.decompress(f.at(e[4], e[5])), bigwig.layout("<", bigwig.ZOOM)) for e in leaves])
        assert len(z) == f.unpack("I", data)[0] and z["n"].sum() == want[0] and np.isclose(z["sum"].sum(dtype=float), want[3])
        assert z["min"].min() == want[1] and z["max"].max() == want[2]
        same = z["chrom"][1:] == z["chrom"][:-1]
        assert (z["start"][1:][same] >= z["end"][:-1][same]).all() and (np.diff(z["chrom"].astype(int)) >= 0).all()
    assert widths == sorted(widths) and len(z) < 500


def _pushed(path, *filters, leaves=1):
    r = bigwig.Reader({"path": path, "leaves": str(leaves)})
    assert list(r.pushFilters(list(filters))) == list(filters)
    parts = r.partitions()
    out = [row for p in parts for b in r.read(p) for row in zip(*(c.to_pylist() for c in b.columns))]
    return r.blocks, sum(len(p.offsets) for p in parts), out


def test_bigwig_filters_read_only_their_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(bigwig, "BLOCK", 16)
    monkeypatch.setattr(bigwig, "NODE", 4)
    path = str(tmp_path / "deep.bw")
    w = bigwig.Writer({"path": path, "sizes": json.dumps({f"c{k}": 10**6 for k in range(9)})})
    every = [(f"c{k}", 20 * i, 20 * i + 10, float(i)) for k in range(5) for i in range(1000)]
    messages = []
    for k in range(0, 5000, 1300):  # four tasks, batches of 100 rows
        part = every[k : k + 1300]
        messages.append(w.write(pa.RecordBatch.from_pylist([dict(zip(("chrom", "start", "end", "value"), r)) for r in part[i : i + 100]]) for i in range(0, len(part), 100)))
    w.commit([messages[2], None, messages[0], messages[3], messages[1]])
    assert not list(tmp_path.glob("*parts*"))
    blocks, leaves, out = _pushed(path)
    assert out == every and blocks > 300 and leaves > 70
    for filters, keep in (
        ((EqualTo(("chrom",), "c3"), GreaterThanOrEqual(("start",), 4000), LessThan(("start",), 4100)), lambda c, s, e: c == "c3" and 4000 <= s < 4100),
        ((In(("chrom",), ("c1", "gone")), GreaterThan(("end",), 9000), LessThanOrEqual(("end",), 9010)), lambda c, s, e: c == "c1" and 9000 < e <= 9010),
        ((EqualTo(("chrom",), "c0"), EqualTo(("start",), 60)), lambda c, s, e: c == "c0" and s == 60),
        ((EqualTo(("chrom",), "c4"), EqualTo(("end",), 70)), lambda c, s, e: c == "c4" and e == 70),
    ):
        blocks, leaves, out = _pushed(path, *filters)
        assert [r for r in out if keep(*r[:3])] == [r for r in every if keep(*r[:3])] and blocks <= 2 and leaves <= 2
    assert _pushed(path, EqualTo(("chrom",), "gone"))[::2] == (0, [])
    assert _pushed(path, EqualTo(("chrom",), "c1"), EqualTo(("chrom",), "c2"))[::2] == (0, [])


def test_bigwig_writer_errors_and_empty(spark, tmp_path):
    schema = "chrom string, start long, end long, value double"
    sizes = spark.createDataFrame([("a", 100)], "chrom string, size long")
    path = str(tmp_path / "none.bw")
    sinks.write_bigwig(spark.createDataFrame([], schema), path, "value", sizes)
    assert tracks.bigwig(spark, path, "+").count() == 0 and tracks.bigwig_sizes(spark, path).count() == 1
    with pytest.raises(Exception, match="overlap"):
        sinks.write_bigwig(spark.createDataFrame([("a", 0, 10, 1.0), ("a", 5, 20, 1.0)], schema), str(tmp_path / "bad.bw"), "value", sizes)
    w = bigwig.Writer({"path": str(tmp_path / "y.bw"), "sizes": json.dumps({"a": 100})})
    batch = lambda *r: iter([pa.RecordBatch.from_pylist([dict(zip(("chrom", "start", "end", "value"), x)) for x in r])])
    for r in (("b", 0, 1, 1.0), ("a", 5, 5, 1.0), ("a", -1, 5, 1.0), ("a", 50, 101, 1.0)):
        with pytest.raises(ValueError):
            w.write(batch(r))
    with pytest.raises(ValueError, match="two tasks"):
        w.commit([w.write(batch(("a", 0, 10, 1.0))), w.write(batch(("a", 5, 20, 1.0)))])
    w.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.bw"]


def test_bigwig_many_chroms(tmp_path, monkeypatch):
    monkeypatch.setattr(bigwig, "NODE", 4)
    path = str(tmp_path / "c.bw")
    sizes = {f"chrom_{k}": 100 + k for k in range(70)}
    w = bigwig.Writer({"path": path, "sizes": json.dumps(sizes)})
    w.commit([w.write(iter([pa.RecordBatch.from_pylist([{"chrom": c, "start": 1, "end": 2, "value": 1.0} for c in sorted(sizes)])]))])
    assert {c: s for c, (_, s) in bigwig.File(path).chroms().items()} == sizes
    assert len(_pushed(path)[2]) == 70


BED = "chrom string, start bigint, end bigint, score double, name string"


def test_bigwig_of_long_chroms(spark, tmp_path):
    """Chroms beyond 32 bits come back whole, by rows, sizes and filters; an interval over a border as one a stretch."""
    s = bigwig.STRETCH
    rows = [(c, k * 1_000_003, k * 1_000_003 + 2, float(k % 9)) for c in ("N", "N1") for k in range(9001)] + [("a", 5, 7, 1.0), ("a", 8, 9, 2.0)]
    over = ("long", s - 3, 3 * s + 4, 5.0)
    sizes = {"N": 54_000_000_000, "N1": 9_100_000_000, "a": 100, "long": 3 * s + 9, "none": 1 << 33}
    path = str(tmp_path / "x.bw")
    sinks.write_bigwig(spark.createDataFrame([*rows, over], "chrom string, start long, end long, value double").repartition(3), path, "value", spark.createDataFrame(list(sizes.items()), "chrom string, size long"))
    pieces = [("long", s - 3, s, 5.0), ("long", s, 2 * s, 5.0), ("long", 2 * s, 3 * s, 5.0), ("long", 3 * s, 3 * s + 4, 5.0)]
    every = sorted([*rows, *pieces])
    x = tracks.bigwig(spark, path, "+").select("chrom", "start", "end", "value")
    assert sorted(map(tuple, x.collect())) == every
    assert dict(map(tuple, tracks.bigwig_sizes(spark, path).collect())) == sizes
    for filters in ([GreaterThan(("end",), 8_000_000_000)], [LessThan(("start",), 10)], [EqualTo(("chrom",), "N"), GreaterThan(("end",), s - 9), LessThan(("start",), s + 2_000_000)], [EqualTo(("chrom",), "none")]):
        r = bigwig.Reader({"path": path})
        list(r.pushFilters(filters))
        w = r.wanted
        want = [x for x in every if (w.chroms is None or x[0] in w.chroms) and x[2] > w.low and x[1] < w.high]
        out = [tuple(row.values()) for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
        assert sorted(set(out) & set(want)) == want and r.blocks < 14
    with pytest.raises(ValueError, match="tab"):
        bigwig.Writer({"path": path, "sizes": json.dumps({"a\t00001": 5})})


@pytest.fixture(scope="module")
def bed_rows():
    r = np.random.default_rng(1)
    out = [(f"chr{c}", int(s), int(s) + int(n), float(v), f"row {k}") for k, (c, s, n, v) in enumerate(zip(r.integers(1, 12, 6000), r.integers(0, 3_000_000, 6000), r.choice([0, 1, 50, 40_000, 2_000_000], 6000, p=[0.1, 0.4, 0.4, 0.09, 0.01]), r.random(6000)))]
    return [*out, ("chr3", 5, 9, None, None), ("chrÄ", 1, 2, 0.5, "é"), out[0]]


@pytest.fixture(scope="module")
def bed_file(spark, bed_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bed") / "x.bed.gz")
    sinks.write_bed(spark.createDataFrame(bed_rows, BED).repartition(5), path)
    return path


def test_bed_blocks_are_plain_gzip(spark, bed_rows, bed_file):
    """Any gzip reader sees one sorted text; blocks are small; the end is marked."""
    import gzip

    lines = gzip.open(bed_file, "rt", encoding="utf-8").read().splitlines()
    keys = [(x.split("\t")[0].encode(), int(x.split("\t")[1])) for x in lines]
    assert keys == sorted(keys) and len(lines) == len(bed_rows) and "chr3\t5\t9\t\t" in lines
    raw = open(bed_file, "rb").read()
    assert raw.endswith(bgzf.END_MARK)
    at, n = 0, 0
    while at < len(raw):
        size = struct.unpack("<H", raw[at + 16 : at + 18])[0] + 1
        assert raw[at : at + 4] == b"\x1f\x8b\x08\x04" and struct.unpack("<I", raw[at + size - 4 : at + size])[0] <= 65280
        at, n = at + size, n + 1
    assert at == len(raw) and n > 4
    assert tracks.bed(spark, bed_file).count() == len(bed_rows)


def test_indexed_bed_read(spark, bed_rows, bed_file):
    x = tracks.indexed_bed(spark, bed_file, BED)
    assert sorted(map(tuple, x.collect()), key=repr) == sorted(bed_rows, key=repr)
    few = x.where("chrom = 'chr7' and end > 1000000 and start < 1005000")
    want = [r for r in bed_rows if r[0] == "chr7" and r[2] > 1_000_000 and r[1] < 1_005_000]
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(want, key=repr) and want
    assert sorted(tracks.indexed_bed(spark, bed_file).columns) == ["chrom", "end", "start"]


def _bed_pushed(spark, path, *filters, piece=bgzf.PIECE):
    from pyspark.sql.types import StructType

    r = bgzf.Reader({"path": path, "piece": str(piece)}, StructType.fromDDL(BED))
    assert list(r.pushFilters(list(filters))) == list(filters)
    parts = r.partitions()
    return r, len(parts), [tuple(row.values()) for p in parts for b in r.read(p) for row in b.to_pylist()]


def test_indexed_bed_reads_only_its_blocks(spark, tmp_path):
    """Many blocks; each range reads few, whatever it cuts, and no row of it is missed."""
    every = sorted((f"chr{k % 3}", 10 * (k // 3), 10 * (k // 3) + (40_000 if k % 500 == 0 else 8), k / 7, f"a name of some length, so that blocks fill up {k}") for k in range(60_000))
    path = str(tmp_path / "y.bed.gz")
    w = bgzf.Writer({"path": path})
    batch = lambda rows: pa.RecordBatch.from_pylist([{"chrom": r[0], "start": r[1], "end": r[2], "line": "\t".join(map(str, r))} for r in rows])
    messages = [w.write(batch(every[k : k + 17_000][i : i + 1000]) for i in range(0, len(every[k : k + 17_000]), 1000)) for k in range(0, 60_000, 17_000)]
    w.commit([messages[3], messages[0], None, messages[2], messages[1]])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["y.bed.gz", "y.bed.gz.tbi"]
    r, n, out = _bed_pushed(spark, path, piece=100_000)
    assert out == every and n > 5 and r.blocks > 50
    for chrom, low, high in (("chr0", 0, 10), ("chr1", 99_990, 100_010), ("chr2", 150_000, 151_000), ("chr0", 16_380, 16_390), ("chr2", 199_000, 10**6)):
        r, _, out = _bed_pushed(spark, path, EqualTo(("chrom",), chrom), GreaterThan(("end",), low), LessThan(("start",), high))
        want = [x for x in every if x[0] == chrom and x[2] > low and x[1] < high]
        assert [x for x in out if x[0] == chrom and x[2] > low and x[1] < high] == want and want and r.blocks < 14
    assert _bed_pushed(spark, path, EqualTo(("chrom",), "gone"))[2] == []
    assert _bed_pushed(spark, path, GreaterThan(("end",), 10**8))[2] == []


def test_bed_errors_and_empty(spark, tmp_path):
    path = str(tmp_path / "none.bed.gz")
    sinks.write_bed(spark.createDataFrame([], BED), path)
    assert open(path, "rb").read() == bgzf.END_MARK and tracks.indexed_bed(spark, path).count() == 0
    w = bgzf.Writer({"path": str(tmp_path / "x.bed.gz")})
    batch = lambda *r: iter([pa.RecordBatch.from_pylist([{"chrom": c, "start": s, "end": e, "line": ""} for c, s, e in r])])
    for bad in ([("a", 5, 4)], [("a", 0, 1 << 30)], [("b", 0, 1), ("a", 0, 1)], [("a", 5, 6), ("a", 4, 9)]):
        with pytest.raises(ValueError):
            w.write(batch(*bad))
    with pytest.raises(ValueError, match="two tasks"):
        w.commit([w.write(batch(("a", 0, 1), ("a", 9, 10))), w.write(batch(("a", 5, 6)))])
    w.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.bed.gz", "none.bed.gz.tbi"]


@pytest.mark.parametrize("far", [1 << 29, 900_000_000, 54_000_000_000])
def test_indexed_bed_of_long_chroms(spark, tmp_path, far):
    """Coordinates beyond tabix: the wide index finds every row of a range and reads few blocks; a later write leaves one index."""
    r = np.random.default_rng(3)
    rows = sorted((f"chr{k % 2}", int(s), int(s) + (far // 5 if k % 400 == 0 else 1), k / 7, f"some name {k}") for k, s in enumerate(r.integers(0, far - far // 5, 20_000)))
    rows.append(("chr1", far - 1, far, 1.0, "last"))
    path = str(tmp_path / "z.bed.gz")
    sinks.write_bed(spark.createDataFrame(rows, BED), path)
    assert (tmp_path / "z.bed.gz.csi").exists() == (far > 1 << 29) and (tmp_path / "z.bed.gz.tbi").exists() == (far <= 1 << 29)
    every, n, out = _bed_pushed(spark, path, piece=20_000)
    assert out == rows and n > 3
    for chrom, low, high in (("chr1", far - 10, far + 5), ("chr0", far // 2, far // 2 + far // 1000), ("chr0", 0, far // 900), ("chr1", far // 3, far // 2), ("chr0", far, 1 << 62)):
        got, _, out = _bed_pushed(spark, path, EqualTo(("chrom",), chrom), GreaterThan(("end",), low), LessThan(("start",), high))
        want = [x for x in rows if x[0] == chrom and x[2] > low and x[1] < high]
        assert [x for x in out if x[0] == chrom and x[2] > low and x[1] < high] == want and got.blocks < every.blocks
    sinks.write_bed(spark.createDataFrame(rows[:10], BED).withColumn("start", F.lit(1)).withColumn("end", F.lit(2)), path)
    assert not (tmp_path / "z.bed.gz.csi").exists() and tracks.indexed_bed(spark, path).count() == 10


def test_index_bins():
    r = np.random.default_rng(2)
    start = r.integers(0, 1 << 28, 500)
    end = start + 2 ** r.integers(0, 27, 500)
    for s, e, b in zip(start.tolist(), end.tolist(), bgzf.bins_of(start, end).tolist()):
        widths = [(k, 29 - 3 * k) for k in range(5, -1, -1)]  # levels from the finest up
        level, shift = next((k, w) for k, w in widths if s >> w == (e - 1) >> w)
        assert b == sum(8**j for j in range(level)) + (s >> shift) and bgzf.start_of(b) == s >> shift << shift and b in bgzf.bins_over(s, s + 1) and b in bgzf.bins_over(e - 1, e)
