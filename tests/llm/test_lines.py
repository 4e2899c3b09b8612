"""Line dedup against all pairs of lines."""

import random

from tidemark.llm import lines


def brute(texts, num=4, den=5):
    seen, out = [], []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        kept = []
        for line in t.split("\n"):
            words = set(line.encode().split())
            match = bool(words) and any(den * len(words & w) >= num * len(words | w) for w in seen)
            if words:
                seen.append(words)
            if not match:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def test_lines(docs, texts):
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want != texts


def near(seed, copies, words=40):
    """Near copies of one line around the threshold, and lines around a passage that many share."""
    r = random.Random(seed)
    base, passage = [f"w{i}" for i in range(words)], [f"p{i}" for i in range(30)]
    texts = []
    for i in range(copies):
        line = list(base)
        for _ in range(r.randint(0, 3)):
            line[r.randint(0, 5) if r.random() < 0.5 else r.randint(0, words - 1)] = f"x{r.randint(0, 30)}"
        other = [f"o{r.randint(0, 10 ** 6)}" for _ in range(r.randint(1, 12))]
        texts.append(" ".join(line) + "\n" + " ".join(passage + other) + ("\n" + " ".join(line[:3] * 2) if i % 3 == 0 else ""))
    return texts


def test_near_lines(spark):
    texts = near(5, 120)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in lines.dedup(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_blanks(spark, monkeypatch):
    """Lines that differ in blanks alone are similar; equal lines are found without a pattern over every line."""
    texts, plans, cut = ["a b c d e", " a  b\tc d e\r\na b c d e", "a b c d e \n \t", "f g"], [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *more))
    got = {x["doc_id"]: x["text"] for x in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts) == ["a b c d e", "", " \t", "f g"]
    assert "h1" in plans[0] and "regexp_replace" not in plans[0]


def test_rare_words_meet_once(spark, monkeypatch):
    """Words of few lines are joined once for all; frequent words alone go through the rounds for groups."""
    r, meetings, pairs = random.Random(3), [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda short, long, *more: meetings.append(long.count()) or pairs(short, long, *more))
    texts = near(5, 300) + [" ".join(f"r{r.randint(0, 3000)}" for _ in range(30)) for _ in range(200)]
    texts += [" ".join(t.split(" ")[:-2]) for t in texts[300:320]]
    got = {x["doc_id"]: x["text"] for x in lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    rare, *frequent = meetings
    assert rare > 1000 and len(frequent) == 2 and 0 < sum(frequent) < rare


def test_long_lines(spark):
    """Lines of thousands of words, beyond what the signatures can tell apart, and a document of many lines."""
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words), " ".join(words[:4400]), " ".join(words[1100:]) + "\n\n" + " ".join(words[500:]), "\n".join(f"line {i} of {i * i} and {i * i * i}" for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in lines.dedup(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_that_share_a_doc_id(spark):
    """Two long texts under one id are two documents; the same row twice is one. Ids above 2**53 beside a null one stay as they are."""
    big = (1 << 60) + 1
    a, b = "\n".join(f"only {i} here a{i} b{i}" for i in range(50)), "\n".join(f"else {i} there c{i} d{i}" for i in range(50))
    rows = spark.createDataFrame([(big, a), (big, b), (big, b), (None, a), (big + 1, b + "\nnew line")], "doc_id long, text string")
    got = sorted(((x["doc_id"] or 0, x["text"], x["n_lines_removed"]) for x in lines.dedup(rows).collect()))
    assert got == sorted([(0, a, 0), (big, a, 0), (big, b, 0), (big, b, 0), (big + 1, "new line", 50)])


def test_odd_rows(odd_docs, no_docs):
    x = lines.dedup(odd_docs)
    rows = x.collect()
    assert len(rows) == 6 and [c for c in x.columns if c != "n_lines_removed"] == [*[c for c in odd_docs.columns if c != "n_lines"], "n_lines"]
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines_removed"]) for r in rows) == [(0, "x y z", 0), (1, "x y z", 0), (1, "x y z", 0), (2, "", 0), (3, "", 1), (3, "other text here", 0)]
    assert lines.dedup(no_docs).count() == 0
