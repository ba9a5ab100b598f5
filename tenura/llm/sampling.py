"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 31


def bounded_by_hash(rows: DataFrame, hashed: Column, n: int, bound: int) -> DataFrame:
    """About `bound` of the `n` rows, those whose hash is small; all rows where there are no more."""
    share = BUCKETS if n <= bound else BUCKETS * bound // n
    return rows.where(F.pmod(hashed, F.lit(BUCKETS)) < share)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of the key; all rows where there are no more.

    No sort and no limit: the share kept follows from one count, so the plan has one shape.
    """
    return bounded_by_hash(rows, F.xxhash64(F.col(key)), rows.count(), bound)
