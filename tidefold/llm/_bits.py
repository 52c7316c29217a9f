"""Bitmaps of a bounded size over 64-bit hashes: a first sieve before exact joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**BITS bits are a megabyte; a bitmap has that at least and 2**MOST_BITS, 16 megabytes, at most.
BITS, MOST_BITS = 23, 27


def bits_for(n: int) -> int:
    """Enough bits that a sixteenth of them is set by n hashes, as far as the bound allows."""
    return min(MOST_BITS, max(BITS, (16 * n).bit_length()))


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of one column of well-mixed longs, ORed by tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(on, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(on)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(on[at].view(np.int64))], names=["at", "x"])

    found = hashes.mapInArrow(run, "at int, x long").groupBy("at").agg(F.bit_or("x").alias("x")).toArrow()
    on = np.zeros(1 << (bits - 6), dtype=np.uint64)
    on[found["at"].to_numpy()] = found["x"].to_numpy().view(np.uint64)
    return on


def among(hashes: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the bitmap."""
    bit = hashes >> np.uint64(64 - 6 - (len(on).bit_length() - 1))
    return ((on[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
