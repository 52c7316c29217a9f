"""Signed-row operators beyond count, sum and average: extremes and inner joins of two maintained tables.

Both keep additive states, as the algebra does, so retractions need no recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.algebra import SIGN

TIMES = "_times"


def value_counts(signed: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The state behind a minimum or maximum: how often each value other than null occurs in each group."""
    return signed.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum(SIGN).cast("long").alias(TIMES))


def merge_counts(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The sum of two states; values that no longer occur vanish, and one that occurs less than never raises."""
    keys = [c for c in state.columns if c != TIMES]
    out = state.unionByName(delta).groupBy(*keys).agg(F.sum(TIMES).cast("long").alias(TIMES)).where(F.col(TIMES) != 0)
    bad = F.raise_error(F.lit("a value occurs less than never")).cast("long")
    return out.withColumn(TIMES, F.when(F.col(TIMES) < 0, bad).otherwise(F.col(TIMES)))


def extremes(state: DataFrame, keys: list[str], column: str, lowest: str, highest: str) -> DataFrame:
    """Minimum and maximum of each group that has a value."""
    return state.groupBy(*keys).agg(F.min(column).alias(lowest), F.max(column).alias(highest))


def joined_changes(left: DataFrame, left_signed: DataFrame, right: DataFrame, right_signed: DataFrame, on: list[str]) -> DataFrame:
    """Signed rows of the inner join of two tables, from both as they were and the signed rows of a batch.

    What is new is changes with old rows, old rows with changes, and changes with changes, whose signs multiply.
    Null keys join with nothing.
    """
    mine, theirs = left_signed.withColumnRenamed(SIGN, "_s"), right_signed.withColumnRenamed(SIGN, "_t")
    columns = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on], SIGN]
    a = mine.join(right, on).withColumnRenamed("_s", SIGN)
    b = left.join(theirs, on).withColumnRenamed("_t", SIGN)
    c = mine.join(theirs, on).withColumn(SIGN, F.col("_s") * F.col("_t"))
    return a.select(*columns).unionByName(b.select(*columns)).unionByName(c.select(*columns))
