"""Order-keyed deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order): the smallest ``order`` of every key combination; null keys are equal.

    An aggregation and not a window: it combines on the map side, so a hot key sends one row a
    partition.
    """
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def keep_priority(df: DataFrame, keys: list[str], priority: str, order: str) -> DataFrame:
    """The row of highest ``priority``, then smallest ``order``, of every key, with the number ``removed``."""
    best = F.min(F.struct((-F.col(priority)).alias("p"), F.col(order).alias("o")))
    out = df.groupBy(*keys).agg(best.alias("_b"), (F.count(F.lit(1)) - 1).alias("removed"))
    return out.select(*keys, (-F.col("_b.p")).alias(priority), F.col("_b.o").alias(order), "removed")


def keep_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value): the value of the largest ``order`` of every key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
