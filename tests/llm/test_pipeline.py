"""The corpus pipeline, stage by stage, against brute force; and the registration of its queries."""

import corpus_pipeline
import public_tokenizers

from tidemark.llm import mixing, queries

from test_fingerprints import brute_components, brute_simhash
from test_lines import brute as brute_lines
from test_selection import brute_base, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    base = {i for i, r in rows.items() if (b := brute_base(r["text"]))[0] >= 50 and 2 * b[4] <= b[0]}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= base and len(ids) > 0.7 * len(base)

    lines = stages[1](spark, kept, SF).cache()
    assert lines.columns == docs.columns
    order = sorted(ids)
    want = dict(zip(order, brute_lines([rows[i]["text"] for i in order])))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want

    near = stages[2](spark, lines, SF).cache()
    assert near.columns == docs.columns
    part = brute_components([brute_simhash(want[i]) for i in order])
    assert {r["doc_id"] for r in near.collect()} == {order[k] for k in set(part)}

    mixed = stages[3](spark, near, SF).cache()
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(near).collect()}
    assert mixed.count() == sum(copies.values())

    packed = stages[4](spark, mixed, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    one = {}
    for r in packed:
        one.setdefault((r["doc_id"], r["piece"]), []).append(r)
    assert all(len(v) == copies[d] for (d, _), v in one.items())
    assert {d for d, _ in one} == {d for d, n in copies.items() if n}
    assert len({r["sequence_id"] for r in packed}) <= sum(r["length"] for r in packed) // 4096 + 2
    assert check_packing and texts and public_tokenizers


def test_odd_input(spark, odd_docs, no_docs):
    """Every stage by itself: empty tables, null texts and ids, repeated rows, clashing names."""
    odd = odd_docs.withColumn("n_chars", odd_docs["doc_id"])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, no_docs, SF).count() == 0
        x = stage(spark, odd, SF)
        rows = x.collect()
        assert k == 4 or x.columns == odd.columns
        ids = sorted((r["doc_id"] or 0) for r in rows)
        assert ids == [[], [0, 1, 1, 2, 3, 3], [1, 2, 3], ids, [0, 1, 1, 2, 3, 3]][k]


def test_near_dedup_rows(spark):
    """Unlike rows without a doc_id all stay, as do unlike texts under one; copies don't, with or without one."""
    text = lambda k: " ".join(f"w{k}x{i * i % 97}" for i in range(60))
    rows = [(None, text(k)) for k in range(5)] + [(7, text(10)), (7, text(11)), (7, text(11)), (8, text(12)), (None, text(12)), (9, text(12)), (None, text(20)), (None, text(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str)
    assert got == sorted([*[(None, text(k)) for k in (0, 1, 2, 3, 4, 20)], (7, text(10)), (7, text(11)), (8, text(12))], key=str)


def test_run_and_registration(spark):
    import __spark_entry__

    registered = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert set(queries.QUERIES) <= set(registered) and registered["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(registered)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_names_of_operators_pass_through(spark, docs):
    """Extra columns that have the names the operators use come back as they were, at every stage; so does a copy of a document's own."""
    names = ["n_lines", "n_lines_removed", "__v", "__lines", "__gone", "__keep", "__row", "__row2", "__copy", "extra", "kept", "first", "d", "rank", "a.b"]
    x = docs
    for k, n in enumerate(names):
        x = x.selectExpr("*", f"concat(doc_id, ' {k}') as `{n}`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, x, SF)
        assert out.columns == x.columns
        rows = out.collect()
        assert rows or stage.__name__ == "quality_rules"
        assert all(r[n] == f"{r['doc_id']} {k}" for r in rows for k, n in enumerate(names))
    assert stage.__name__ == "source_mixing"
