"""The algebra of maintained aggregates, as DataFrames.

A view's state has its keys, ``_rows`` (live rows of the group) and additive columns: a count for each ``count``, an
exact sum ``<alias>__sum`` and the number of its inputs ``<alias>__nn`` for each ``sum`` and ``avg``.  States of disjoint sets
of rows add up, and rows that leave count with sign -1, so

    state(rows + changes) = merge(state(rows), fold(changes)).

Merging is a union and an aggregation, never a join on keys, so null keys form one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.errors import SchemaDriftError, SetupError
from tidefold.functions.values import exact, scale, summable
from tidefold.plans.spec import NN, ROWS, SUM, ViewSpec

SIGN = "_sign"
AVG_SCALE = 6


def check_source(view: ViewSpec, schema: T.StructType) -> None:
    """The source has the columns that the view needs, and sums and averages are over numbers."""
    there = {f.name: f.dataType for f in schema}
    if missing := [c for c in view.needed if c not in there]:
        raise SchemaDriftError(f"view {view.name}: {view.source} has no column {', '.join(missing)}")
    for a in view.aggregates:
        if a.fn != "count" and not summable(there[a.column]):
            raise SetupError(f"view {view.name}: {a.fn} of {a.column}, which is {there[a.column].simpleString()}")
    for k in view.group_by:
        if isinstance(there[k], (T.MapType, T.VariantType)):
            raise SetupError(f"view {view.name}: the key {k} is {there[k].simpleString()}")


def state_schema(view: ViewSpec, schema: T.StructType) -> T.StructType:
    """The columns of the view's state over a source of the given schema."""
    fields = [T.StructField(k, schema[k].dataType) for k in view.group_by] + [T.StructField(ROWS, T.LongType())]
    for a in view.aggregates:
        if a.fn == "count":
            fields.append(T.StructField(a.alias, T.LongType()))
        else:
            fields += [T.StructField(a.alias + SUM, T.DecimalType(38, scale(schema[a.column].dataType))), T.StructField(a.alias + NN, T.LongType())]
    return T.StructType(fields)


def _signed(value: Column, sign: Column | None) -> Column:
    return value if sign is None else F.when(sign < 0, -value).otherwise(value)


def _partials(view: ViewSpec, schema: T.StructType, sign: Column | None) -> list[Column]:
    one = F.lit(1) if sign is None else sign
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = [total(one).cast("long").alias(ROWS)]
    for a in view.aggregates:
        if a.fn == "count":
            out.append(total(one if a.column is None else F.when(F.col(a.column).isNotNull(), one)).cast("long").alias(a.alias))
        else:
            kind = schema[a.column].dataType
            value = exact(F.col(a.column), kind, a.column)
            out.append(total(_signed(value, sign)).cast(T.DecimalType(38, scale(kind))).alias(a.alias + SUM))
            out.append(total(F.when(F.col(a.column).isNotNull(), one)).cast("long").alias(a.alias + NN))
    return out


def backfill(view: ViewSpec, rows: DataFrame) -> DataFrame:
    """The state over a snapshot of the source."""
    check_source(view, rows.schema)
    return rows.groupBy(*view.group_by).agg(*_partials(view, rows.schema, None))


def fold(view: ViewSpec, signed: DataFrame) -> DataFrame:
    """The state's change over signed rows: one row for each touched group, and exactly one for a view without keys."""
    check_source(view, signed.schema)
    return signed.groupBy(*view.group_by).agg(*fold_columns(view, signed.schema))


def fold_columns(view: ViewSpec, schema: T.StructType) -> list[Column]:
    """The aggregates of ``fold``, with the types of the state's columns; they can be used for any batch."""
    return _partials(view, schema, F.col(SIGN))


def added(view: ViewSpec, rows: DataFrame) -> DataFrame:
    """State rows added up by group, whatever their sums."""
    columns = [c for c in rows.columns if c not in view.group_by]
    sums = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in columns]
    if not view.group_by:
        sums = [F.coalesce(s, F.lit(0)).cast(rows.schema[c].dataType).alias(c) for s, c in zip(sums, columns, strict=True)]
    return rows.groupBy(*view.group_by).agg(*sums)


def total(view: ViewSpec, rows: DataFrame) -> DataFrame:
    """The state that a first state and all changes of it add up to.  Groups without rows vanish; one with fewer than none raises."""
    bad = F.raise_error(F.lit(f"view {view.name}: a group has fewer rows than none")).cast("boolean")
    # a filter, since a column that nobody reads would not be looked at
    return added(view, rows).where(F.when(F.col(ROWS) < 0, bad).otherwise(F.col(ROWS) != 0 if view.group_by else F.lit(True)))


def merge(view: ViewSpec, state: DataFrame, delta: DataFrame) -> DataFrame:
    """The sum of a state and a change of it."""
    return total(view, state.unionByName(delta.select(*state.columns)))


def empty_state(spark: SparkSession, view: ViewSpec, schema: T.StructType) -> DataFrame:
    """The state over no rows: no group, or the one row of a view without keys."""
    return backfill(view, spark.createDataFrame([], schema)) if not view.group_by else spark.createDataFrame([], state_schema(view, schema))


def project(view: ViewSpec, state: DataFrame) -> DataFrame:
    """What users see: keys and one column for each aggregate; sums and averages of no inputs are null."""
    out = [F.col(k) for k in view.group_by]
    for a in view.aggregates:
        if a.fn == "count":
            out.append(F.col(a.alias))
            continue
        total, n = F.col(a.alias + SUM), F.col(a.alias + NN)
        value = total if a.fn == "sum" else (total / n).cast(T.DecimalType(38, AVG_SCALE))
        out.append(F.when(n > 0, value).alias(a.alias))
    return state.select(*out)
