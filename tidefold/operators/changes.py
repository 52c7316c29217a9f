"""Changes of source tables to signed rows.

A change row is ``end_lsn, seq, op, table, old, new, unchanged``: the position after its transaction, its number in it, I, U, D or
T, the table, the old and new values by column, and the columns whose new value was not sent because it is unchanged.
Values are a struct of the table's columns or a map of texts (as the log has them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.errors import SchemaDriftError
from tidefold.functions.values import typed
from tidefold.operators.algebra import SIGN

#: The schema of a log of changes of any tables.
CHANGE_DDL = "end_lsn long, seq int, op string, table string, old map<string, string>, new map<string, string>, unchanged array<string>"


def of_table(changes: DataFrame, table: str, after: int | None = None) -> DataFrame:
    """The changes of one table, and only those behind a position: redelivered transactions are skipped."""
    out = changes.where(F.col("table") == table)
    return out if after is None else out.where(F.col("end_lsn") > after)


def last_truncate(changes: DataFrame) -> tuple[int, int] | None:
    """Where the last truncation of one table's changes is, as (end_lsn, seq)."""
    at = changes.where("op = 'T'").agg(F.max(F.struct("end_lsn", "seq")).alias("at")).first()["at"]
    return (at["end_lsn"], at["seq"]) if at else None


def _value(side: str, column: str, kind: T.DataType, texts: bool) -> Column:
    return typed(F.col(side).getItem(column), kind) if texts else F.col(f"{side}.`{column}`")


def signed_rows(changes: DataFrame, schema: T.StructType, needed: tuple[str, ...], cut: tuple[int, int] | None = None) -> DataFrame:
    """The needed columns of one table's changes with ``_sign``: +1 for a row that comes, -1 for one that goes.

    Changes up to ``cut``, the last truncation, have no effect.  An update is its old row going and its new row coming;
    a value that was not sent is the old one.  Without the old values of an update or a delete, or with a column of the
    new row neither sent nor marked unchanged, nothing right can be said, and an error is raised.
    """
    return after_cut(changes, cut).select(signed_column(isinstance(changes.schema["new"].dataType, T.MapType), schema, needed))


def after_cut(changes: DataFrame, cut: tuple[int, int] | None) -> DataFrame:
    """The changes of rows behind a truncation."""
    return changes.where("op IN ('I', 'U', 'D')" + (f" AND (end_lsn > {cut[0]} OR end_lsn = {cut[0]} AND seq > {cut[1]})" if cut else ""))


def signed_column(texts: bool, schema: T.StructType, needed: tuple[str, ...]) -> Column:
    """The generator of ``signed_rows``; ``texts``: values are maps of texts.  It can be used for any batch."""
    there = {f.name: f.dataType for f in schema}
    if missing := [c for c in needed if c not in there]:
        raise SchemaDriftError(f"the source has no column {', '.join(missing)}")
    no_old = F.raise_error(F.concat(F.lit("an update or delete lacks its old row, at "), F.col("end_lsn").cast("string")))
    old_there = F.when(F.col("op").isin("U", "D") & F.col("old").isNull(), no_old.cast("boolean")).otherwise(F.col("old").isNotNull())
    no_column = lambda side, c: F.raise_error(F.lit(f"a {side} row lacks the column {c}")).cast(there[c])

    def value(side: str, c: str) -> Column:
        v = _value(side, c, there[c], texts)
        return F.when(F.map_contains_key(side, F.lit(c)), v).otherwise(no_column(side, c)) if texts else v

    old = [value("old", c).alias(c) for c in needed]
    new = [F.when(F.array_contains(F.coalesce("unchanged", F.array().cast("array<string>")), c), F.when(F.col("op") == "U", value("old", c)).otherwise(no_column("new", c))).otherwise(value("new", c)).alias(c) for c in needed]
    going = F.when(old_there & F.col("op").isin("U", "D"), F.struct(F.lit(-1).alias(SIGN), *old))
    coming = F.when(F.col("op").isin("I", "U"), F.struct(F.lit(1).alias(SIGN), *new))
    # two structs, of which some are null: no shuffle and no second scan
    return F.inline(F.filter(F.array(going, coming), lambda x: x.isNotNull()))
