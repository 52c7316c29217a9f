"""Small tables with everything that may be odd in them."""

import random

import pytest
from pyspark.sql import functions as F

#: Names that clash with those the operators give to columns of their own.
CLASHING = "size rank n row token k1 k2 w lines key host path rule gone found digest top shard q kind start end r id h sketch label a b line site component rep comp cut".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in df.columns])


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = text(1, 30_000)
    rows = [
        (1, text(10, 60), "en", "s1"),
        (2, text(10, 60), "en", "s2"),
        (3, text(10, 60)[:-6] + " changed.", "en", "s3"),
        (4, None, "en", "s1"),
        (5, "", None, None),
        (6, " \t\n\v\f\r", "en", "s2"),
        (7, "one two three", "en", "s3"),
        (8, "One TWO three", "en", "s3"),
        (9, long, "en", "s1"),
        (10, long, "en", "s1"),
        (None, text(11, 40), "en", "s4"),
        (None, None, None, None),
        (12, text(12, 30), "en", None),
        (12, text(12, 30), "en", None),
        (13, "é" * 50_000, "fr", "s2"),
        (14, "语 言\u00a0x  y", "zh", "s2"),
    ]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
