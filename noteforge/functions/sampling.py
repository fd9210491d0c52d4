"""Bounded samples that depend on the rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the smallest hashes of `key` (ties by `key`), all rows if there are no more.

    A cut-off of the hash, from the number of rows, keeps little more than n rows before they are put in order; so the one task that orders them
    gets as many on a thousand partitions as on one. (Should fewer than n pass it, which takes a deviation of over five in the number that do, they are the sample.)
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    total = df.count()
    if total > 2 * n:
        share = (n + 6 * n**0.5 + 20) / total
        df = df.where(h <= F.lit(-(1 << 63) + int(share * (1 << 64))))
    return df.orderBy(h, key).limit(n)
