import random

import pytest
from pyspark.sql import functions as F

# columns whose names the operators use inside
CLASHING = ("tid", "row", "rep", "key", "starts", "spans", "anchor", "anchors", "score", "start", "h", "n", "sig", "ws",
            "win", "comp", "part", "no", "length", "component_id", "kept", "toxic", "vec_id", "item_id", "g")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages, scripts, copies."""
    rng = random.Random(3)
    passage, long = prose(rng, 120), prose(rng, 6000)
    body = prose(rng, 300)
    near = body.split(" ")
    near[40], near[200] = "changed", "words"
    rows = [(0, None), (1, ""), (2, " \n\t \r\n"), (3, "one"), (4, "One"), (5, long), (6, long + " tail"),
            (7, "É É ñandú 日本語。 x"), (8, "É É ñandú 日本語。 x"), (9, prose(rng, 30) + " " + passage),
            (10, passage + "\n" + prose(rng, 80)), (11, "A" * 5000), (12, "ab " * 900), (13, body), (14, " ".join(near)),
            (15, body), (13, body), (None, body), (16, "two words"), (17, prose(rng, 49)), (18, prose(rng, 50)),
            (19, "a b  c\u0085 d　e"), (20, passage), (21, "\x00\x1c odd \x7f bytes")]
    rows += [(30 + i, prose(rng, rng.randrange(1, 200))) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def edges():
    return edge_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edges):
    """The edge rows with null and clashing columns, over a few partitions."""
    rows = [(i, t, None if i is None or i % 5 == 0 else ("aa", "bb")[i % 2], None, i) for i, t in edges]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
