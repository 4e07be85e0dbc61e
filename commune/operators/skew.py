"""Skew-safe equi-joins against a per-key table.

A hot key (a hub vertex, a giant community) can hold a third of all rows. Sending all of
them to one shuffle partition would make one task do a third of the work, so the per-key
table carries a ``hot`` flag, set by a rule that bounds the number of hot keys by the
partition count. Rows of hot keys are joined against a broadcast of the hot keys only
(a size-bounded table), the rest by an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_threshold(total_rows: int, partitions: int, floor: int) -> int:
    """Rows above which one key is hot: twice a partition's fair share, never below ``floor``.

    Keys above it number at most ``partitions / 2``, so the hot set is bounded by the
    partition count whatever the data.
    """
    return max(2 * (total_rows // max(partitions, 1)), int(floor))


def lookup(facts: DataFrame, dim: DataFrame, key: str, hot_col: str = "hot", broadcast_all: bool = False) -> DataFrame:
    """Inner join ``facts`` with ``dim`` (one row per ``key``) without a hot-key partition.

    ``broadcast_all`` is set by callers that hold a proven bound on ``dim``'s size.
    """
    dim_cols = [c for c in dim.columns if c != hot_col]
    if broadcast_all:
        return facts.join(F.broadcast(dim.select(*dim_cols)), key)
    hot = dim.where(F.col(hot_col)).select(*dim_cols)
    cold = dim.where(~F.col(hot_col)).select(*dim_cols)
    marked = facts.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot_key"))), key, "left")
    via_broadcast = marked.where(F.col("_hot_key").isNotNull()).drop("_hot_key").join(F.broadcast(hot), key)
    via_shuffle = marked.where(F.col("_hot_key").isNull()).drop("_hot_key").join(cold.hint("shuffle_hash"), key)
    return via_broadcast.unionByName(via_shuffle)
