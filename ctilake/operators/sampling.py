"""Samples that are the same on every run: rows are ordered by a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.sources.tables import broadcast_if_small, cut


def hash_order(key: str, seed: int = 42) -> list[Column]:
    """Order by the MD5 of ``seed|key``, then by the key."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of every stratum. The limit is pushed below the shuffle, so a hot stratum moves n rows a partition."""
    w = W.partitionBy(*strata).orderBy(*hash_order(key, seed))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def balanced(df: DataFrame, strata: list[str], label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows with label 1 as with label 0 in every stratum, the first in hash order.

    Rows are first cut by a threshold on the hash that the wanted number almost surely stays below, so
    a hot stratum sorts little more than it keeps. Where a threshold was too low after all, which is
    counted, everything is sorted.
    """
    n = [F.count_if(F.col(label) == y).alias(f"_n{y}") for y in (0, 1)]
    sizes = cut(df.groupBy(*strata).agg(*n).withColumn("_m", F.least("_n0", "_n1")).filter("_m > 0"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    of = F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n0"))
    joined = df.filter(F.col(label).isin(0, 1)).join(broadcast_if_small(sizes), strata)
    near = joined.filter(drawn <= (F.col("_m") + 8 * F.sqrt("_m") + 16) / of)
    short = near.groupBy(*strata, label).agg(F.count(F.lit(1)).alias("_c"), F.max("_m").alias("_w")).filter("_c < _w")
    groups = near.select(*strata, label).distinct().count()
    whole = joined if groups < 2 * sizes.count() or not short.isEmpty() else near
    w = W.partitionBy(*strata, label).orderBy(*hash_order(key, seed))
    return whole.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("_m")).drop("_rn", "_m", "_n0", "_n1")


def top_of_strata(df: DataFrame, sizes: DataFrame, strata: list[str], parts: list[str], key: str, most_column: str, most: int, seed: int = 42) -> DataFrame:
    """Of every part of the strata in ``sizes`` as many rows in hash order as its column says, which is at most ``most``.

    The constant bound is applied first and below the shuffle, so a hot part moves ``most`` rows a partition.
    """
    w = W.partitionBy(*strata, *parts).orderBy(*hash_order(key, seed))
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return ranked.join(sizes, strata).filter(F.col("_rn") <= F.col(most_column)).drop("_rn", most_column)


def per_stratum_counts(df: DataFrame, limits: DataFrame, stratum: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """All rows with label 1 and as many others of every stratum, in hash order, as ``limits`` (stratum, _m) allows."""
    w = W.partitionBy(stratum, label).orderBy(*hash_order(key, seed))
    ranked = df.withColumn("_rn", F.row_number().over(w)).join(F.broadcast(limits), stratum)
    return ranked.filter((F.col(label) == 1) | (F.col("_rn") <= F.col("_m"))).drop("_rn", "_m")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows taken in turn from the strata in name order; ``turn`` is the round a row was taken in."""
    w = W.partitionBy(stratum).orderBy(*hash_order(key, seed))
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", stratum).limit(n)
