"""Text values of the replication protocol to typed values, in Python and as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Object ids of PostgreSQL's types.
BOOL_OID, INT_OIDS, FLOAT_OIDS, NUMERIC_OID = 16, (20, 21, 23, 26), (700, 701), 1700


def convert_value(text: str | None, oid: int) -> object:
    """A value of a type: bool, int, float or Decimal; text for all other types; None for null."""
    if text is None:
        return None
    if oid == BOOL_OID:
        return text == "t"
    if oid == NUMERIC_OID:
        return Decimal(text)
    return int(text) if oid in INT_OIDS else float(text) if oid in FLOAT_OIDS else text


def typed(text: Column, kind: T.DataType) -> Column:
    """A text column as ``kind``; a text that is no such value raises (ANSI casts)."""
    if isinstance(kind, T.BooleanType):
        return F.when(text.isNotNull(), text.isin("t", "true"))
    return text.cast(kind)


def exact(c: Column, kind: T.DataType, name: str) -> Column:
    """A numeric column as an exact decimal; NaN and infinities raise.  Floats count as their shortest decimal text."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        checked = F.when(bad, F.raise_error(F.lit(f"column {name} holds a value that is not finite")).cast(kind)).otherwise(c)
        return checked.cast("string").cast(T.DecimalType(38, scale(kind)))
    return c.cast(T.DecimalType(38, scale(kind)))


def scale(kind: T.DataType) -> int:
    """Digits after the point that sums of a type carry."""
    return kind.scale if isinstance(kind, T.DecimalType) else 18 if isinstance(kind, (T.FloatType, T.DoubleType)) else 0


def summable(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
