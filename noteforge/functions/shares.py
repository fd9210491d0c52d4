"""Shares of a table: sequences of updates over all its rows, side by side, where one sequence over all of them would be one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, key: str, shares: int, seed: int = 0) -> DataFrame:
    """All rows, with `share` and `place`: the rows of a share are those of some hashes of `key`, and a partition of its own. `place` (of 64 bits) puts them in an order that depends
    on the rows only, but for rows of one key.

    The share comes from the high bits of the hash, so that it says nothing of the order within it beyond them.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    share = F.pmod(F.shiftrightunsigned(h, 20), F.lit(shares)).cast("int")
    return df.withColumn("place", h).withColumn("share", share).repartitionById(shares, F.col("share"))


def shares_for(rows: int, most: int) -> int:
    """How many shares of about `most` rows hold all rows; one if they fit it."""
    if most < 1:
        raise ValueError("a share has at least one row")
    return max(1, -(-rows // most))
