"""Toxicity, quality rules, packing and mixing."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing, quality, toxicity

BIG = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_toxicity_held_out(spark):
    """Rows that the fit never saw."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.toxicity(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    n = Counter((r["toxic"], r["predicted"]) for r in x.collect())
    precision, recall = n[1, 1] / (n[1, 1] + n[0, 1]), n[1, 1] / (n[1, 1] + n[1, 0])
    print(f"held out: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.9


def spelled(text):
    """Runs of a text's different words as tuples of symbols."""
    out = []
    for w in sorted(set(text.lower().split())):
        symbols = [toxicity.EDGE, *(int(toxicity.ALPHABET[min(ord(c), 65535)]) for c in w), toxicity.EDGE]
        out += [tuple(symbols[max(0, i - toxicity.ORDER + 1) : i + 1]) for i in range(1, len(symbols))]
    return out


def number(run):
    n = 0
    for symbol in run:
        n = n << toxicity.BITS | symbol
    return n


def brute_models(toxic, ordinary, chance):
    """Both models by dictionaries; returns a function from words to their log-likelihood ratios."""
    n = [Counter(), Counter()]
    docs = [Counter(), Counter()]
    for c, texts in enumerate((toxic, ordinary)):
        for t in texts:
            n[c].update(spelled(t))
            docs[c].update(set(spelled(t)))
    known = sorted(r for r in docs[0] | docs[1] if docs[0][r] + docs[1][r] >= toxicity.FEWEST)
    discount = lambda v: (lambda a, b: a / (a + 2 * b) if a else 0.5)(sum(x == 1 for x in v), sum(x == 2 for x in v))
    before = defaultdict(set)  # what stands before a run
    for r in known:
        for k in range(1, len(r)):
            before[r[-k:]].add(r[-k - 1])
    by_length = {k: [r for r in before if len(r) == k] for k in range(1, toxicity.ORDER)}
    cut = {k: discount([len(before[r]) for r in rs]) for k, rs in by_length.items()}
    every = {r[-1:] for r in known}

    def lower(run):
        k = len(run)
        base = 1 / (len(every) + 1) if k == 1 else lower(run[1:])
        here = [len(before[r]) for r in by_length[k] if r[:-1] == run[:-1]]
        return (max(len(before.get(run, ())) - cut[k], 0) + cut[k] * len(here) * base) / sum(here)

    def totals(counts):
        out = Counter()
        for r in known:
            out[r[:-1]] += counts[r]
        return out

    pool = Counter({r: n[0][r] + n[1][r] for r in known})
    d, total = discount(list(pool.values())), totals(pool)
    free = Counter()
    for r in known:
        free[r[:-1]] += min(pool[r], d)
    shared = {r: (max(pool[r] - d, 0) + free[r[:-1]] * lower(r[1:])) / total[r[:-1]] for r in known}
    in_docs = [totals(x) for x in docs]

    def surprise(r):
        share = (docs[0][r] + docs[1][r]) / (in_docs[0][r[:-1]] + in_docs[1][r[:-1]])
        g = 0.0
        for c in (0, 1):
            k, m = docs[c][r], in_docs[c][r[:-1]]
            g += 2 * ((k * math.log(k / (m * share)) if k else 0) + ((m - k) * math.log((m - k) / (m * (1 - share))) if k < m else 0))
        return g

    sure = {r for r in known if surprise(r) >= chance}
    sure |= {r[:k] for r in sure for k in range(2, len(r))}
    p, rest = [], []
    for c in (0, 1):
        d, total = discount([n[c][r] for r in known]), totals(n[c])
        gone = {r: min(n[c][r], d) if r in sure else n[c][r] for r in known}
        freed = totals(gone)
        rest.append({x: freed[x] / total[x] if total[x] else 1.0 for x in total.keys() | {r[:-1] for r in known}})
        p.append({r: ((n[c][r] - gone[r]) / total[r[:-1]] if total[r[:-1]] else 0) + rest[c][r[:-1]] * shared[r] for r in known})

    def ratio(word):
        out = 0.0
        for r in spelled(word):
            if r in shared:
                out += math.log(p[0][r] / p[1][r])
            elif r[:-1] in rest[0]:
                out += math.log(max(rest[0][r[:-1]], 1e-6) / max(rest[1][r[:-1]], 1e-6))
        return out

    return ratio, len(sure)


def test_toxicity_models():
    """Models and sums against dictionaries; long texts in one part and in many."""
    r = random.Random(4)
    syllables = ["ba", "do", "ré", "gu", "lin", "mor", "ß", "日本", "x1"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    ordinary = [" ".join(word() for _ in range(30)) for _ in range(60)]
    toxic = [" ".join([*(word() for _ in range(25)), *("Bad" + word() for _ in range(5))]) for _ in range(25)]
    ratio, sure = brute_models(toxic, ordinary, toxicity.CHANCE)
    assert sure >= 4
    rows = [toxicity._summed([(*np.unique(toxicity.runs(toxicity.words_of(t)), return_counts=True), np.ones(len(set(spelled(t))), np.int64)) for t in x]) for x in (toxic, ordinary)]
    every = np.unique(np.concatenate([x[0] for x in rows]))
    n, docs = ([np.bincount(np.searchsorted(every, x[0]), x[k], len(every)) for x in rows] for k in (1, 2))
    some = docs[0] + docs[1] >= toxicity.FEWEST
    model = {k: toxicity._packed(*v) for k, v in toxicity.kneser_ney(every[some], [x[some] for x in n], [x[some] for x in docs]).items()}
    texts = [*toxic[:5], *ordinary[:5], "", "new words", "badbadbad BAD bad", " \n", "a" * 40]
    llr, words = toxicity.measure(texts, model)
    for t, got, m in zip(texts, llr, words):
        each = [ratio(w) for w in toxicity.words_of(t)]
        far = [v - np.median(each) for v in each]
        assert m == len(each) and abs(got - sum(v for v in far if abs(v) >= toxicity.EVEN)) < 1e-4
    assert toxicity.runs(["ab", "c"]).tolist() == [number(x) for x in spelled("ab c")]
    size, toxicity.SLICE = toxicity.SLICE, 20
    try:
        assert np.allclose(toxicity.measure(texts, model)[0], llr)
    finally:
        toxicity.SLICE = size


def test_toxicity_ids(spark, labels):
    """Ids above 2**53 beside a null one, a very long text and a repeated row."""
    big = (1 << 60) + 1
    rows = [(big, "some words"), (None, "more words"), (big, "some words"), (big + 1, "word salad " * 50_000)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels).collect()
    assert sorted((x["doc_id"] or 0) for x in got) == [0, big, big, big + 1]


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labels, no_labels, docs):
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, no_labels).collect()} == {0.0}


def brute_base(text):
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    dup = sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    repeat = {k for i, g in enumerate(grams) if g in twice for k in (i, i + 1, i + 2)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


def test_quality(spark, docs, texts):
    """Counts against plain code, verdicts against dictionaries of the same buckets."""
    known = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, known, threshold=0.0).collect()}
    target, raw = defaultdict(float), defaultdict(float)
    grams = [quality._buckets(t or "", quality._Hashes()).tolist() for t in texts]
    for i, g in enumerate(grams):
        for b in g:
            raw[b] += 1
            target[b] += i % 3 == 0
    half = quality.BUCKETS // 2
    total = {(k, h): sum(n for b, n in x.items() if (b < half) == h) + 0.5 * half for k, x in (("t", target), ("r", raw)) for h in (True, False)}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        llr = np.mean([np.log((target[b] + 0.5) / total["t", b < half]) - np.log((raw[b] + 0.5) / total["r", b < half]) for b in grams[i]]) if grams[i] else 0
        assert abs(llr - r["llr"]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["llr"] >= 0)
    assert {r["doc_id"] for r in quality.keep(docs, known, threshold=0.0).collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_labels(spark):
    """Junk goes and other documents stay, on labels that say so."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    x = quality.quality(docs, labels).where("not base_failed").join(labels, "doc_id")
    n = Counter((r["quality"], r["kept"]) for r in x.collect())
    print("quality, kept:", n)
    assert n[1, False] <= 0.01 * n[1, True]
    assert n[0, False] >= 0.8 * (n[0, True] + n[0, False])


def test_quality_odd_rows(odd_docs, no_docs, labels, no_labels, docs):
    assert quality.quality(odd_docs, labels).count() == 6 and quality.keep(odd_docs, labels).columns == odd_docs.columns
    assert quality.quality(no_docs, labels).count() == 0
    assert {r["llr"] for r in quality.quality(docs, no_labels).collect()} == {0.0}


def test_packing_ids(spark):
    """Ids above 2**53 beside a null one, two texts under one id, and a text of many pieces."""
    big = (1 << 60) + 1
    rows = [(None, "a b"), (big, "c"), (big, "d e f"), (big + 1, "long text " * 30_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), TOKENIZER).collect()
    assert {x["doc_id"] for x in got} == {None, big, big + 1} and sum(x["doc_id"] == big for x in got) == 2
    assert sorted((x["start"], x["piece"]) for x in got if x["doc_id"] == big + 1) == [(4096 * k, k) for k in range(sum(x["doc_id"] == big + 1 for x in got))]


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(TOKENIZER)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    sequences = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(part) == r["length"] and zlib.crc32(np.asarray(part, "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
    return sequences


def test_packing(docs, texts):
    for capacity in (4096, 64):
        rows = packing.pack(docs, TOKENIZER, capacity).collect()
        n = len(check_packing(rows, texts, capacity))
        assert n <= -(-sum(r["length"] for r in rows) // capacity) + 2


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_packing_constraints(docs, texts, rule):
    with pytest.raises(ValueError):
        packing.plan({256: 1}, 256, 3, 30_000)
    short = [i for i, t in enumerate(texts) if len((t or "").split()) < 20]
    rows = packing.pack(docs.where(F.col("doc_id").isin(short)), TOKENIZER, 256, max_docs=3, max_cost=30_000, rule=rule).collect()
    assert len(rows) == len(short)
    for s in _by_sequence(rows):
        assert len(s) <= 3 and sum(n * n for n in s) <= 30_000 and sum(s) <= 256


def _by_sequence(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append(r["length"])
    return out.values()


def test_tokens_of_words():
    """Words by themselves give a text's ids, whatever is in it."""
    import random

    r, t, ids = random.Random(1), Tokenizer.from_file(TOKENIZER), packing._Ids(TOKENIZER)
    letters = "aZéÉßÿ×÷ªºµ¼İıΣσςǅ①²٣_'’.,!<|>-—\U0001f600\u0301\u0308 \t\n\x1c\x85\xa0 日本'sre<|endoftext|>K"
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert ids.text(x) == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, TOKENIZER).collect()
    assert len(rows) == 6 and len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_mixing(docs, texts):
    rows = mixing.report(docs).collect()
    sizes = defaultdict(int)
    for i, t in enumerate(texts):
        sizes[["b", "a", None][i % 3]] += len((t or "").encode().split())
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    weights = {"a": 3, "b": 1, None: 2}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:  # reshare until none is above its cap
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        free -= over
    taken = defaultdict(int)
    for r in rows:
        s = ["b", "a", None][r["doc_id"] % 3]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 250 for s in sizes)
    assert sorted(rows) == sorted(mixing.report(docs.repartition(5)).collect())
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows)


def test_mixing_odd_rows(odd_docs, no_docs):
    assert mixing.report(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert {(r["doc_id"], r["size"]) for r in mixing.report(odd_docs).collect()} == {(None, 3), (1, 6), (2, 0), (3, 3)}
