"""The preprocessing pipeline: filters, cleaning, exact and near deduplication and a sample over time, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions import text as X
from ctilake.functions.common import n_rows

STAGES = ["forum", "text", "timestamp", "real_timestamp", "language", "length", "score"]


def candidates(raw: DataFrame, key: str, cleaner: Callable[[Column], Column] = X.clean_text, blocked: tuple[str, ...] = (), real_timestamp: bool = True, least_ascii: float = 0.85, words: tuple[int, int] = (4, 2000), least_score: int = 0) -> DataFrame:
    """(key, forum_id, text, day, score, failed) of every row; ``failed`` is the first stage that drops it, null for those kept.

    The text is the body, or the title where the body is empty; the day is that of the timestamp,
    else of the fetch. Texts of at least half but less than ``least_ascii`` ASCII need a language
    detector, without which they are rejected. Null columns count as empty.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    chosen = F.when(F.trim(empty("body")) != "", F.col("body")).otherwise(empty("thread_title"))
    rows = raw.select(F.col(key).alias("key"), "forum_id", cleaner(chosen).alias("text"), F.coalesce(X.iso_date(F.col("timestamp")), X.iso_date(F.col("scraped_at"))).alias("day"), (empty("timestamp") != empty("scraped_at")).alias("real"))
    rows = rows.withColumn("score", X.cti_score(F.col("text")))
    tests = [empty("forum_id").isin(*blocked) if blocked else F.lit(False), F.col("text") == "", F.col("day").isNull(), ~F.col("real") if real_timestamp else F.lit(False), X.ascii_ratio(F.col("text")) < least_ascii, ~X.word_count(F.col("text")).between(*words), F.col("score") < least_score]
    failed = F.lit(None).cast("string")
    for name, drops in list(zip(STAGES, tests))[::-1]:
        failed = F.when(drops, name).otherwise(failed)
    return rows.withColumn("failed", failed)


def first_of_texts(rows: DataFrame) -> DataFrame:
    """Of the kept rows the one with the smallest key for every text."""
    keep = F.min_by(F.struct("key", "forum_id", "day", "score"), "key").alias("k")
    return rows.filter("failed is null").groupBy(X.fingerprint(F.col("text")).alias("fp")).agg(keep).select("k.*")


def temporal_sample(rows: DataFrame, n: int, spells: int) -> DataFrame:
    """At most ``n`` of (key, day, score): every span of time gives by its share, at least one, its highest scores first.

    Shares round half to even; what is too much then goes by score, earlier spans first. A table of at
    most ``n`` rows is returned whole, and one whose days are all equal is one span.
    """
    ends = rows.agg(F.min(F.unix_date("day")).alias("lo"), F.max(F.unix_date("day")).alias("hi"), n_rows().alias("all"))
    step = F.try_divide((F.unix_date("day") - F.col("lo")) * F.lit(float(spells)), F.col("hi") - F.col("lo"))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("spell", F.greatest(F.lit(0), F.least(F.lit(spells - 1), F.coalesce(F.floor(step).cast("int"), F.lit(0)))))
    sizes = placed.groupBy("spell").agg(F.greatest(F.lit(1), F.bround(n * n_rows() / F.max("all"), 0).cast("int")).alias("quota"))
    w = W.partitionBy("spell").orderBy(F.desc("score"), "key")
    # the constant bound comes first, so that a hot span moves n rows a partition; a table that is small enough stays whole
    inside = placed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).join(F.broadcast(sizes), "spell").filter((F.col("place") <= F.col("quota")) | (F.col("all") <= n))
    return inside.orderBy(F.desc("score"), "spell", "place").limit(n).select("key", "spell", "score")
