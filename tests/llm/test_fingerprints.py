"""Winnowing, SimHash and substring dedup against brute force."""

import hashlib
import math

import xxhash

from tidemark.llm import simhash, substring, winnow

SEEDED = 42


def spark_hash(words):
    """Spark's hash of several strings: each one's is the next one's seed."""
    h = SEEDED
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h >> 25


def chosen(text, k=5, window=8):
    words = [w.decode() for w in (text or "").encode().split()]
    if not words:
        return []
    grams = [(spark_hash(words[i : i + k]), -i) for i in range(max(len(words) - k + 1, 1))]
    return sorted({min(grams[i : i + window]) for i in range(max(len(grams) - window + 1, 1))}, key=lambda g: -g[1])


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(docs, texts):
    rows = {r["doc_id"]: r for r in winnow.fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", (texts[i - 1] or "")
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        own, other = chosen(t), chosen(edited)
        r = rows[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{-p}:{h:x}" for h, p in own)
        assert r["edited_fingerprint"] == " ".join(f"{-p}:{h:x}" for h, p in other)
        assert math.isclose(r["near_edited"], alike(own, other)) and math.isclose(r["near_next"], alike(own, chosen(after)))


def test_winnowing_guarantee():
    """A run of k + window - 1 shared words leaves a shared gram."""
    run = "q w e r t y u i o p a s"
    assert {h for h, _ in chosen(f"one two {run} three")} & {h for h, _ in chosen(f"{run} four five six")}


def test_winnowing_odd_rows(spark, odd_docs, no_docs):
    rows = winnow.fingerprints(odd_docs).collect()
    assert len(rows) == 6
    last = [r for r in rows if r["doc_id"] is None]
    assert len(last) == 1 and last[0]["n_chars"] == 5
    assert winnow.fingerprints(no_docs).count() == 0
    one = winnow.fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def brute_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, texts):
    prints = [brute_simhash(t) for t in texts]
    want = brute_components(prints)
    got = {r["doc_id"]: r for r in simhash.components(docs).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(want)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect()) == sorted(set(want))


def test_simhash_dense_buckets(spark):
    """Thousands of fingerprints around one: links by tiles, by stars and by pairs connect the same."""
    import random

    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 700:
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))))
    fps = sorted(fps)
    want = brute_components(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for rows in (1 << 15, 100):
        edges = simhash.stars(simhash.links(nodes, bucket_rows=rows)).collect()
        at = {f: i for i, f in enumerate(fps)}
        root = {e["u"] % (1 << 64): e["v"] % (1 << 64) for e in edges}
        groups = {}
        for f in fps:
            groups.setdefault(root.get(f, f), set()).add(at[f])
        brute = {}
        for i, c in enumerate(want):
            brute.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = simhash.components(odd_docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 1), (3, 3)]
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert simhash.components(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def brute_substring(texts, window=50):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_substring(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substring(texts)
    assert sum(v[1] for v in got.values()) > 500


def test_substring_few_words(spark):
    """Periodic texts: many equal windows in one document, ties between grams, and matches at every offset."""
    texts = [" ".join("abc"[i % 3] for i in range(90)), " ".join("abc"[(i + 1) % 3] for i in range(70)) + " d " + " ".join("a" * 60), "a " * 49, "a " * 50, "d " + "a " * 55 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substring(texts)


def test_substring_odd_rows(spark, odd_docs, no_docs):
    assert substring.dedup(odd_docs).count() == 6 and substring.dedup(no_docs).count() == 0
    long = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in substring.dedup(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]


def test_substring_rows_that_share_a_doc_id(spark):
    """Each row is judged by its own text, none against one with its id; ids above 2**53 stay as they are beside a null one."""
    big = (1 << 60) + 1
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(80))
    rows = [(big, a), (big, b), (big, a + " " + b), (big + 1, b + " end"), (None, a), (big + 2, "x " + a[: len(a) // 2])]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    half = len(a[: len(a) // 2].split())
    cut = half - (a[: len(a) // 2].split()[-1] != f"a{half - 1}")
    assert got == [(0, 300, 0), (big, 80, 0), (big, 300, 0), (big, 380, 0), (big + 1, 81, 80), (big + 2, half + 1, cut)]


def test_parse():
    """Pieces that go on at the next place of one reference are one factor."""
    assert substring.parse([0, 3, 10], [3, 2, 5], [1, 1, 1], [7, 10, 17], 50) == [(0, 54, 1, 7), (10, 54, 1, 17)]
    assert substring.parse([3, 0], [2, 3], [1, 2], [10, 7], 50) == [(0, 52, 2, 7), (3, 51, 1, 10)]
    assert substring.parse([0, 3], [3, 2], [1, 1], [7, 11], 50) == [(0, 52, 1, 7), (3, 51, 1, 11)]


def test_substring_long_text(spark):
    """A text of 200,000 words that holds an earlier document in its middle."""
    early = " ".join(f"e{i % 977}x{i // 7}" for i in range(4000))
    late = " ".join(f"l{i}" for i in range(98_000))
    texts = [early, f"{late} {early} {' '.join(f'm{i}' for i in range(98_000))}"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (4000, 0), 1: (200_000, 4000)}


def test_likeness_of_whole_hashes(spark):
    """Grams whose hashes differ in their last shown bits only are unlike."""
    x = spark.createDataFrame([([(5 << 24) + 9, (6 << 24) + 8, (900 << 24) + 7], [(5 << 24) + 3, (7 << 24) + 2])], "a array<long>, b array<long>")
    r = x.select(winnow.hashes(x["a"]).alias("a"), winnow.likeness(winnow.hashes(x["a"]), winnow.hashes(x["b"])).alias("likeness")).first()
    assert r["a"] == [5, 6, 900] and r["likeness"] == 0.25
