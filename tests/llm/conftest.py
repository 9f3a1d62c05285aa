import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # columns with names that operators use within
    + [T.StructField(c, T.LongType()) for c in ("class", "size", "line", "words", "places", "stat")]
)


def rows_of(texts, first=0):
    return [(i + first, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Prose with copies, near copies, shared passages and lines, nulls, empty texts, one very long text and ties."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(3000)] + ["the", "of", "And", "é", "Ünder"] * 200
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(min(k, 12))) + "." for k in [12] * (n // 12) + [n % 12] if k)
    out = [prose(r.randint(1, 200)) for _ in range(60)]
    passage = prose(30)
    out += [t + "\n" + passage for t in out[:6]]
    out += out[10:14] + [out[20]] * 5
    for t in out[30:36]:
        words = t.split(" ")
        for _ in range(max(1, len(words) // 40)):
            words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [None, "", " \n\t ", None, "one", "One\x0btwo\x0cthree", " x y ﻿", "same line of five words here\n" * 4, prose(6000), "x" * 5000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts) + [rows_of(texts)[3]], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Null ids, and rows that repeat an id with another text."""
    rows = rows_of(texts[:20])
    return spark.createDataFrame(rows + [(None, *x[1:]) for x in rows[:3]] + [(5, *x[1:]) for x in rows[6:8]], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, len(texts), 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
