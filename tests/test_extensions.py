"""Extremes and joins from signed rows against fresh computations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidefold.operators import extensions as x
from tidefold.operators.algebra import SIGN


def history(seed, n):
    """(rows before, signed changes, rows after)"""
    rng = random.Random(seed)
    row = lambda: (rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None, rng.randint(0, 50)]))
    before = [row() for _ in range(n)]
    gone, come = rng.sample(before, n // 3), [row() for _ in range(n // 4)]
    after = list((Counter(before) - Counter(gone) + Counter(come)).elements())
    return before, [(*r, -1) for r in gone] + [(*r, 1) for r in come], after


def test_extremes(spark):
    before, changes, after = history(1, 60)
    rows = lambda r: spark.createDataFrame(r, "k string, v int")
    state = x.value_counts(rows(before).withColumn(SIGN, F.lit(1)), ["k"], "v")
    state = x.merge_counts(state, x.value_counts(spark.createDataFrame(changes, f"k string, v int, {SIGN} int"), ["k"], "v"))
    fresh = rows(after).where("v is not null").groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert Counter(map(tuple, x.extremes(state, ["k"], "v", "lo", "hi").collect())) == Counter(map(tuple, fresh.collect()))
    with pytest.raises(Exception, match="less than never"):
        x.merge_counts(state, x.value_counts(spark.createDataFrame([("a", 999, -1)], f"k string, v int, {SIGN} int"), ["k"], "v")).collect()


def test_joined_changes(spark):
    (a0, da, a1), (b0, db, b1) = history(2, 30), history(3, 30)
    left, right = (lambda r: spark.createDataFrame(r, "k string, v int")), (lambda r: spark.createDataFrame(r, "k string, w int"))
    signed = x.joined_changes(left(a0), spark.createDataFrame(da, f"k string, v int, {SIGN} int"), right(b0), spark.createDataFrame(db, f"k string, w int, {SIGN} int"), ["k"])
    got = Counter(map(tuple, left(a0).join(right(b0), "k").collect()))
    for *r, s in map(tuple, signed.collect()):
        got[tuple(r)] += s
    assert +got == Counter(map(tuple, left(a1).join(right(b1), "k").collect())) and min(got.values()) >= 0
