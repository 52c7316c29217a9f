"""Log positions: 64-bit numbers, written ``HI/LO`` in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.errors import EngineError


def parse_lsn(text: str) -> int:
    parts = text.split("/")
    try:
        hi, lo = (int(x, 16) for x in parts)
    except ValueError as e:
        raise EngineError(f"invalid log position: {text!r}") from e
    return hi << 32 | lo


def format_lsn(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def lsn_from_text(c: Column) -> Column:
    """``parse_lsn`` on a column; positions with the top bit set don't fit a long and raise."""
    hi, lo = (F.conv(F.split_part(c, F.lit("/"), F.lit(k)), 16, 10).cast("long") for k in (1, 2))
    out = F.shiftleft(hi, 32).bitwiseOR(lo)
    return F.when(out < 0, F.raise_error(F.concat(F.lit("log position out of range: "), c)).cast("long")).otherwise(out)


def lsn_to_text(c: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(c, 32)), F.lit("/"), F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF))))
