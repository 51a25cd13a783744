"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.operators.timezones import earliest_instant, normalise_timestamps, zone_scores
from ctilake.sources.tables import table


def _tables(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """(name, arguments) of both tables: posts were written before they were loaded, pages were fetched after the post."""
    posts, raw = table(spark, sf_dir, "forum_posts"), table(spark, sf_dir, "raw_posts")
    loaded = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    return [
        ("forum_posts", posts, "post_key", "timestamp", table(spark, sf_dir, "forums"), "forum_id", {"not_after": loaded, "order": F.col("post_key")}),
        ("raw_posts", raw, "row_id", "scraped_at", table(spark, sf_dir, "crawlers"), "crawler_id", {"not_before": earliest_instant(F.col("timestamp"))}),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable timestamp of both tables as one instant: (tbl, row_key, utc_us)."""
    posts, raw = [normalise_timestamps(df, key, value, sources, source, **kw).select(F.lit(name).alias("tbl"), "row_key", "utc_us") for name, df, key, value, sources, source, kw in _tables(spark, sf_dir)]
    return posts.unionByName(raw)


def p4_zone_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well every candidate zone fits every source, declared zones included, for review."""
    posts, raw = [zone_scores(df, value, sources, source, **kw).withColumn("tbl", F.lit(name)) for name, df, key, value, sources, source, kw in _tables(spark, sf_dir)]
    return posts.unionByName(raw)


QUERIES = {"p4_found": p4_found, "p4_zone_evidence": p4_zone_evidence}
SQL: dict[str, str] = {}
