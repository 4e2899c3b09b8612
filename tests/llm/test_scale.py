"""Importance resampling, sharding and tokenizer alignment against brute force."""

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import alignment, importance, sharding

A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
BIG = 2**60 + 1


def rows_of(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture(scope="module")
def long_docs(spark):
    """A very long text, a very long word, and a null beside a large id."""
    rows = [(BIG, "alpha beta gamma. " * 20_000), (None, "one two three " * 10), (BIG + 1, "x" * 100_000), (3, "one two three " * 10)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


# importance resampling


def fold(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, longest=2):
    w = fold(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_scores(docs, target, buckets=10_000, longest=2, percent=25, min_words=20, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, longest)) for texts in ([x for _, x in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for k, x in docs:
        g = [gain(bucket(f)) for f in grams(x, longest)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, x) in zip(out, docs) if len(fold(x)) >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return out


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_scores_equal_brute_force(spark, docs, longest):
    target = ["a B c-d é9 " * 3, None, "", "beibon conurs", "日本 x_y"]
    got = importance.score(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, min_words=5)
    want = brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], target, longest=longest, min_words=5)
    assert sorted(map(list, got.collect())) == sorted(want)
    assert sum(r[4] is not None for r in want) > 5


def test_tries_start_anew_with_the_same_totals(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(importance, "NODES", 50)
    monkeypatch.setattr(importance, "TOGETHER", 30)
    trie = importance.Trie(97, 2)
    import pyarrow as pa

    for group in importance.split(pa.array(texts)):
        trie.count(group)
    trie.flush()
    want = Counter(zlib.crc32(g.encode()) % 97 for x in texts for g in grams(x))
    assert trie.totals.tolist() == [want[b] for b in range(97)]
    gained = importance.Trie(97, 2, np.arange(97))
    got = [np.stack(gained.sums(g)) for g in importance.split(pa.array(texts))]
    assert np.concatenate(got, 1).T.tolist() == [[len(grams(x)), sum(zlib.crc32(g.encode()) % 97 for g in grams(x))] for x in texts]


def test_resampling_keeps_the_drawn_rows_whole(spark, docs, odd_docs, no_docs, long_docs):
    target = spark.createDataFrame([("beibon conurs " * 9,)], "text string")
    drawn = {r["doc_id"] for r in importance.score(docs, target).where("rank is not null").collect()}
    got = importance.resample(docs, target)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == drawn
    assert rows_of(importance.resample(odd_docs, target, percent=100, min_words=0)) == rows_of(odd_docs)
    assert importance.resample(odd_docs, target).count() == 0
    assert importance.score(no_docs, target).count() == 0 and importance.resample(no_docs, target).count() == 0
    assert importance.score(docs, no_docs).count() == docs.count()
    want = brute_scores([(r["doc_id"], r["text"]) for r in long_docs.collect()], ["beibon conurs " * 9], percent=100)
    assert sorted(map(list, importance.score(long_docs, target, percent=100).collect()), key=repr) == sorted(want, key=repr)


# sharding


def brute_jump(k, n):
    b, j = -1, 0
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((k >> 33) + 1)))
    return b


def brute_hash(key, seed=0):
    return int(hashlib.md5(f"{seed}:{'null' if key is None else f'key {key}'}".encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 24, 64, 65, 500, 10_000])
def test_jumps_equal_brute_force(spark, shards):
    from pyspark.sql import functions as F

    keys = [0, 1, 2**63, 2**64 - 1, *(brute_hash(i) for i in range(300))]
    x = spark.createDataFrame([(str(k),) for k in keys], "k string").select("k", sharding.jump(F.col("k").cast("decimal(20,0)"), shards).alias("s"))
    assert {int(r["k"]): r["s"] for r in x.collect()} == {k: brute_jump(k, shards) for k in keys}


def test_jumps_beyond_the_usual_number_go_on(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "USUAL", 2)
    keys = [brute_hash(i) for i in range(200)]
    x = spark.createDataFrame([(str(k),) for k in keys], "k string").select("k", sharding.jump(F.col("k").cast("decimal(20,0)"), 100).alias("s"))
    assert {int(r["k"]): r["s"] for r in x.collect()} == {k: brute_jump(k, 100) for k in keys}


def check_shards(got, docs, shards):
    rows, by = got.collect(), defaultdict(list)
    text = defaultdict(list)
    for r in docs.collect():
        t = (r["text"] or "").encode()
        text[r["doc_id"]].append((len(t) + 8, zlib.crc32(t)))
    for r in rows:
        assert r["law"] == "key" and (r["shard"], r["grown_shard"]) == tuple(brute_jump(brute_hash(r["doc_id"]), n) for n in (shards, shards + 1))
        by[r["shard"]].append(r["slot"])
        text[r["doc_id"]].remove((r["size"], r["text_crc32"]))
    assert not any(text.values()) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_and_slots(spark, docs, odd_docs, no_docs, long_docs):
    for x in (docs, odd_docs, no_docs, long_docs):
        check_shards(sharding.assign(x, 5), x, 5)
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) doc_id", "'same' text")
    check_shards(sharding.assign(hot, 24), hot, 24)


def test_appended_shards_take_rows_only_into_themselves(spark):
    x = spark.range(4000).selectExpr("id doc_id", "cast(id as string) text", "'mine' slot")
    moved = sharding.moves(x, 24, 26).collect()
    assert {r["to_shard"] for r in moved} == {24, 25} and all(r["slot"] == "mine" for r in moved)
    assert abs(len(moved) - 4000 * 2 / 26) < 70
    with pytest.raises(ValueError):
        sharding.moves(x.withColumnRenamed("slot", "to_shard"), 2, 3)


def test_written_shards_round_trip(spark, docs, odd_docs, no_docs, tmp_path):
    for k, x in enumerate((docs, odd_docs, no_docs)):
        sharding.write(x, f"{tmp_path}/{k}", 3, file_bytes=4000)
        if x.isEmpty():
            continue
        back = spark.read.schema(x.withColumn("shard", sharding.shard_of("doc_id", 3)).schema).parquet(f"{tmp_path}/{k}")
        assert rows_of(back.select(*x.columns)) == rows_of(x)
        assert all(r["shard"] == brute_jump(brute_hash(r["doc_id"]), 3) for r in back.collect())
    assert len(list((tmp_path / "0").rglob("*.parquet"))) > 3


# alignment


def brute_alignment(docs):
    """Every text by itself, token by token."""
    import base64

    import tiktoken
    from sentencepiece import SentencePieceProcessor

    # the first vocabulary is there as ranks, too: another library reads it
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    first = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = SentencePieceProcessor(model_file=B)
    spell = {v: k for k, v in ranks.items()}
    out, links = [], []
    for k, t in docs:
        a, b = (first.encode_ordinary(" " + t), second.encode(t)) if t else ([], [])
        pieces = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        a_bytes = [spell[i] for i in a]
        if not t or not b"".join(a_bytes) == b"".join(pieces) == b" " + t.encode():
            out.append([k, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(a_bytes), ends(pieces)
        both = sorted(set(ea) & set(eb))
        inside = lambda ids, ends: [ids[bisect_right(ends, lo) : bisect_right(ends, hi)] for lo, hi in zip([0, *both[:-1]], both)]
        groups = list(zip(inside(a, ea), inside(b, eb)))
        links.append([(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f] if len(a) < 500 else [(g[0][-1], g[1][-1]) for g in groups])
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append([k, len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(text.encode()).hexdigest()])
    count = Counter(p for x in links for p in x)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r[:5], sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), r[5]) for r, x in zip(out, links)], count


def test_alignment_equals_brute_force(spark, docs, long_docs, monkeypatch):
    special = spark.createDataFrame([(-1, "a <|endoftext|> b <s> </s> <0x41>"), (-2, "▁x y"), (-3, "two  blanks\ttab\n\nlines  "), (-4, "\U0001f600 café naïve 日本語 ال"), (-5, " ")], "doc_id long, text string")
    x = docs.select("doc_id", "text").unionByName(special).unionByName(long_docs.where("doc_id is null or doc_id <> 3"))
    want, count = brute_alignment([(r["doc_id"], r["text"]) for r in x.collect()])
    got = alignment.align(x, A, B)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    assert len({r[5] == r[4] for r in want if r[4]}) == 2  # some texts have links that aren't their B id's best
    assert {(r["a"], r["b"]): r["count"] for r in alignment.id_pairs(x, A, B).collect()} == dict(count)


def test_ranks_and_merges_give_the_same_ids(texts, tmp_path):
    """The library for ranks against the one that the file is made for; a file that says more goes to the latter."""
    import json
    import random

    from tokenizers import Tokenizer

    r = random.Random(4)
    odd = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x2FFF), r.randrange(0xE000, 0x1FFFF), 10, 32, 39])) for _ in range(60)) for _ in range(400)]
    every = [t or "" for t in texts] + odd + ["it's 'S 12  34\n\n x<|endoftext|>y "]
    spelled, encode = alignment.byte_level(A)
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    got = encode(every)
    assert got == [x.ids for x in plain.encode_batch(every, add_special_tokens=False)]
    assert all(b"".join(spelled[i] for i in ids) == t.encode() for t, ids in zip(every, got))
    file = json.load(open(A))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "more.json").write_text(json.dumps(file))
    assert alignment.byte_level(str(tmp_path / "more.json"))[1](["ab"]) == encode([" ab"])


def test_small_chunks_give_the_same(spark, docs, odd_docs, no_docs):
    def run(x):
        return rows_of(alignment.align(x, A, B))

    want, kept = run(docs), (alignment.DISTINCT, alignment.HELD, alignment.TOGETHER)
    try:
        alignment.DISTINCT, alignment.HELD, alignment.TOGETHER = 40, 100, 200
        assert run(docs) == want
    finally:
        alignment.DISTINCT, alignment.HELD, alignment.TOGETHER = kept
    assert [r["n_a"] > 0 for r in run(odd_docs.where("doc_id <> 2"))] == [True] * 4 and alignment.align(odd_docs, A, B).count() == odd_docs.count()
    assert run(no_docs) == []
