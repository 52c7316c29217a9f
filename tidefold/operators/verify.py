"""Maintained views against fresh aggregations of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.algebra import backfill, project
from tidefold.plans.spec import ROWS, ViewSpec

TOLERANCE = 1e-6


def ground_truth(view: ViewSpec, rows: DataFrame) -> DataFrame:
    """What the view must be over the rows."""
    return project(view, backfill(view, rows))


def _same(fn: str, a: Column, b: Column) -> Column:
    if fn != "avg":
        return a.eqNullSafe(b)
    return F.coalesce(F.abs(a - b) <= TOLERANCE, a.isNull() & b.isNull())


def differences(view: ViewSpec, truth: DataFrame, target: DataFrame) -> DataFrame:
    """``problem, column`` and the keys: groups missing or extra in the target, and cells that differ; averages within 1e-6 agree."""
    t = truth.select(*[F.col(c).alias(f"t_{c}") for c in truth.columns], F.lit(True).alias("in_truth"))
    v = target.select(*[F.col(c).alias(f"v_{c}") for c in target.columns], F.lit(True).alias("in_target"))
    on = F.lit(True)
    for k in view.group_by:
        on = on & F.col(f"t_{k}").eqNullSafe(F.col(f"v_{k}"))
    both = t.join(v, on, "full_outer") if view.group_by else t.withColumn("_g", F.lit(1)).join(v.withColumn("_h", F.lit(1)), F.col("_g") == F.col("_h"), "full_outer")
    problems = [F.when(F.col("in_target").isNull(), F.struct(F.lit("missing group").alias("problem"), F.lit(None).cast("string").alias("column"))), F.when(F.col("in_truth").isNull(), F.struct(F.lit("extra group").alias("problem"), F.lit(None).cast("string").alias("column")))]
    shared = F.col("in_truth") & F.col("in_target")
    for a in view.aggregates:
        differ = shared & ~_same(a.fn, F.col(f"t_{a.alias}"), F.col(f"v_{a.alias}"))
        problems.append(F.when(differ, F.struct(F.lit("cell").alias("problem"), F.lit(a.alias).alias("column"))))
    keys = [F.coalesce(f"t_{k}", f"v_{k}").alias(k) for k in view.group_by]
    return both.select(*keys, F.inline(F.filter(F.array(*problems), lambda x: x.isNotNull())))


def dead_groups(state: DataFrame) -> DataFrame:
    """Groups that should have vanished."""
    return state.where(F.col(ROWS) <= 0)


def in_order(view: ViewSpec, rows: DataFrame) -> DataFrame:
    """Rows by key, nulls first, for display."""
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in view.group_by])
