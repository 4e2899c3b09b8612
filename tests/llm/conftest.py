import random

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b", "\n\n", "a  b c\x1fd", "é É ß 日本 \U0001f600"]


def make_texts(seed: int = 0, n: int = 60) -> list:
    """Random texts with copies, near copies, shared passages, repeated lines, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "ei", "on", "urs")]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, line = sentence(70), sentence(12)
    out = list(ODD)
    for i in range(n):
        lines = [sentence(r.randint(1, 40)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(r.randint(0, len(lines)), line)
        if i % 7 == 0:
            lines.insert(0, f"{sentence(3)} {passage} {sentence(4)}")
        if i % 4 == 3:
            words = out[r.randint(len(ODD), len(out) - 1)].split(" ")
            if i % 8 == 3 and len(words) > 3:
                words[r.randint(0, len(words) - 1)] = "changed"
            lines = [" ".join(words)]
        out.append("\n".join(lines))
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A null id, repeated rows, two texts under one id, and columns with clashing names."""
    rows = [(None, "x y z", "q"), (1, "x y z", "q"), (1, "x y z", "q"), (2, None, None), (3, "other text here", "q"), (3, "x y z", "r")]
    x = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("score", "predicted", "n_words", "kept", "fp", "component_id", "size", "copies", "copy", "rank", "start", "n", "task", "part", "host", "v", "url", "lang", "n_lines"):
        x = x.selectExpr("*", f"'mine' as {c}")
    return x


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
