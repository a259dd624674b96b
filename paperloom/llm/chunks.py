"""Even chunks: groups of rows that fill one partition each.

Rows are grouped by a hash, and a chunk's number is one whose own hash leads to
the chunk's partition, so that no task gets several chunks while others get none.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_of(values: np.ndarray, partitions: int) -> np.ndarray:
    """The hash partition that Spark gives to integers (Murmur3, 32 bits, seed 42)."""
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        h ^= h >> np.uint32(16)
    return h.astype(np.int32).astype(np.int64) % partitions


def labels(chunks: int) -> list[int]:
    """For each of the partitions, an integer that Spark sends there."""
    n = int(chunks * (log(chunks + 1) + 12))
    values = np.arange(n)
    while True:
        found, first = np.unique(partition_of(values, chunks), return_index=True)
        if len(found) == chunks:
            return values[first].tolist()
        values = np.arange(2 * len(values))


def chunk_of(chunks: int, *columns: str | Column) -> Column:
    """The chunk of a row, by its columns."""
    at = F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int")
    return F.element_at(F.lit(np.array(labels(chunks), np.int32)), at + 1)


def chunks_for(df: DataFrame, chunks: int | None) -> int:
    """A number of chunks given, or the session's number of shuffle partitions."""
    return chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
