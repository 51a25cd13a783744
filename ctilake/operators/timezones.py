"""Normalisation of mixed timestamp notations and zones to instants in UTC.

Zone-less values take the zone declared for their source. A source without a declared zone has
its offset history chosen from the candidates, zones with their changes of offset: explicit offsets
written by the same source, instants that the value may not precede or follow (such as the time of
ingestion) and the known instants of the rows before and after it in the source's own order are
compared with every candidate, and the candidate with the fewest violations wins. UTC is the prior
and keeps its place unless another candidate is better by more than ``margin`` of the compared rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions import timestamps as T
from ctilake.functions.text import iso_timestamp
from ctilake.sources.tables import broadcast_if_small, collected_if_small

PRIOR = "UTC"
SEQUENCE = 4096  # consecutive order numbers that are looked at together for neighbours, so no task holds a whole source
# Zones that are tried beside the declared ones, one or two for every offset in common use.
COMMON = [
    "Pacific/Honolulu", "America/Anchorage", "America/Los_Angeles", "America/Denver", "America/Chicago", "America/New_York", "America/Bogota", "America/Halifax", "America/Sao_Paulo", "Europe/London", "Europe/Lisbon", "Europe/Berlin",
    "Europe/Athens", "Africa/Lagos", "Europe/Istanbul", "Europe/Moscow", "Asia/Dubai", "Asia/Tehran", "Asia/Karachi", "Asia/Kolkata", "Asia/Dhaka", "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Adelaide", "Australia/Sydney", "Pacific/Auckland",
]


def _read(df: DataFrame, value: str, sources: DataFrame, source: str) -> DataFrame:
    """``df`` with the written fields: ``_epoch``, ``_local``, ``_zone``, ``_offset`` and the source's ``_tz``."""
    dims = sources.select(F.col(source).alias("_source"), F.when(T.is_known_zone("tz"), F.col("tz")).alias("_tz"), F.col("date_order").alias("_order")).dropDuplicates(["_source"])
    rows = df.join(broadcast_if_small(dims), df[source] == F.col("_source"), "left").withColumn("_v", T.tidy(F.col(value)))
    rows = rows.withColumn("_f", T.fields(F.col("_v"), F.col("_order"))).withColumn("_epoch", T.epoch_us(F.col("_v")))
    return rows.withColumn("_local", T.wall_clock_us(F.col("_f"))).withColumn("_zone", F.nullif(F.col("_f")[8], F.lit(""))).withColumn("_offset", T.explicit_offset_us(F.col("_zone")))


def earliest_instant(value: Column) -> Column:
    """The earliest instant that a Unix time or an ISO value can mean in any zone, in microseconds, whatever the session's zone is; null for other notations.

    The bounds of other columns need no more than that; the whole reader would make the plan a multiple of its size.
    """
    named = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(T.epoch_us(value), F.unix_micros(iso_timestamp(value)) - F.when(named, 0).otherwise(14 * 3_600_000_000))


def zone_scores(df: DataFrame, value: str, sources: DataFrame, source: str, not_before: Column | None = None, not_after: Column | None = None, order: Column | None = None, only_missing: bool = False) -> DataFrame:
    """Violations of every candidate zone for every source: (source, zone, rank, declared, compared, violations, slack_us).

    Candidates are the declared zones, UTC and the common ones, a dimension that does not grow with
    the data. A row whose value has a non-zero explicit offset violates a candidate that has another
    offset at that instant. A zone-less row violates it when its wall clock never occurs there, or
    when its instant lies before ``not_before``, after ``not_after``, before the last known instant in
    front of it or after the next one behind it, by ``order`` (a number; neighbours are looked up
    within runs of SEQUENCE of them). Rows are pre-aggregated by (source, candidate) on the map side.
    """
    null = F.lit(None).cast("long")
    named = collected_if_small(sources.filter(T.is_known_zone("tz")).select(F.col(source).alias("_named"), "tz"))
    if only_missing:  # before anything is read: most rows have a zone
        df = df.join(named.select("_named"), df[source] == F.col("_named"), "left_anti")
    df = df.select(F.col(source).alias("source"), F.col(value).alias("value"), (null if not_before is None else not_before).alias("_low"), (null if not_after is None else not_after).alias("_high"), (null if order is None else order).cast("long").alias("_order_no"))
    rows = _read(df, "value", sources.withColumnRenamed(source, "source"), "source")
    if only_missing:
        rows = rows.filter(F.col("_tz").isNull())
    declared = {r[0] for r in named.select("tz").distinct().collect()} - {PRIOR}  # at most the zones that the JVM knows
    ranked = [(PRIOR, 0), *[(z, 1) for z in sorted(declared)], *[(z, 2) for z in COMMON if z not in declared]]
    rows = rows.select("source", "_tz", "_local", "_offset", "_zone", "_low", "_high", "_order_no", F.coalesce("_epoch", F.col("_local") - F.col("_offset")).alias("_known"))
    if order is not None:
        run = W.partitionBy("source", F.floor(F.col("_order_no") / SEQUENCE)).orderBy("_order_no", "_local", "_known")
        before, behind = F.last("_known", True).over(run.rowsBetween(W.unboundedPreceding, -1)), F.first("_known", True).over(run.rowsBetween(1, W.unboundedFollowing))
        rows = rows.withColumn("_prev", before).withColumn("_next", behind)
        # where known instants themselves do not follow the order it says nothing
        rows = rows.withColumn("_low", F.greatest("_low", F.when(F.col("_prev") <= F.col("_next"), F.col("_prev")))).withColumn("_high", F.least("_high", F.when(F.col("_prev") <= F.col("_next"), F.col("_next"))))
    rows = rows.withColumn("_z", F.explode(F.expr("array(" + ", ".join(f"named_struct('zone', '{z}', 'rank', {r})" for z, r in ranked) + ")"))).select("*", "_z.zone", "_z.rank")
    instant = T.local_to_utc_us(F.col("_local"), F.col("zone"))
    explicit = F.col("_offset").isNotNull() & (F.col("_offset") != 0)
    bounded = F.col("_zone").isNull() & (F.col("_low").isNotNull() | F.col("_high").isNotNull())
    outside = F.coalesce(instant < F.col("_low"), F.lit(False)) | F.coalesce(instant > F.col("_high"), F.lit(False)) | instant.isNull()
    # no filter on _local: it would be pushed below the projection and read every value twice
    against = F.when(F.col("_local").isNull(), None).when(explicit, F.coalesce(F.col("_local") - F.col("_offset") != instant, F.lit(True))).when(bounded, outside)
    slack = F.when(bounded & ~outside, F.least(instant - F.col("_low"), F.col("_high") - instant))
    return rows.groupBy("source", "zone", "rank").agg(F.max("_tz").alias("declared"), F.count(against).alias("compared"), F.coalesce(F.sum(against.cast("long")), F.lit(0)).alias("violations"), F.floor(F.avg(slack)).alias("slack_us"))


def estimate_zones(scores: DataFrame, margin: float = 0.02) -> DataFrame:
    """(source, zone): the candidate with fewest violations, UTC unless it is beaten by more than ``margin``.

    Among equals a zone declared for another source comes first, then the one whose instants lie closest to their bounds.
    """
    cost = F.col("violations") - F.when(F.col("zone") == PRIOR, F.col("compared") * margin).otherwise(0.0)
    return scores.groupBy("source").agg(F.min_by("zone", F.struct(cost, "rank", F.coalesce("slack_us", F.lit(2**62)), "zone")).alias("zone"))


def normalise_timestamps(df: DataFrame, key: str, value: str, sources: DataFrame, source: str, not_before: Column | None = None, not_after: Column | None = None, order: Column | None = None) -> DataFrame:
    """(row_key, utc_us) for every readable value; unreadable ones are left out.

    Left out: null and empty values, relative phrases, impossible dates, wall clocks that never
    occur in their zone, unknown zone abbreviations. A missing or unknown source counts as UTC
    with day before month.
    """
    estimated = estimate_zones(zone_scores(df, value, sources, source, not_before, not_after, order, only_missing=True)).select(F.col("source").alias("_s"), F.col("zone").alias("_estimated"))
    estimated = collected_if_small(estimated)
    rows = _read(df.select(F.col(key).alias("row_key"), F.col(value).alias("value"), F.col(source).alias("source")), "value", sources.withColumnRenamed(source, "source"), "source")
    rows = rows.join(estimated, F.col("source") == F.col("_s"), "left")
    written = F.col("_zone")
    named = F.when(written.isNull(), F.coalesce(F.col("_tz"), F.col("_estimated"), F.lit(PRIOR))).when(T.is_known_zone("_zone") & written.contains("/"), written)
    utc = F.when(F.col("_epoch").isNotNull(), F.col("_epoch")).when(F.col("_offset").isNotNull(), F.col("_local") - F.col("_offset")).otherwise(T.local_to_utc_us(F.col("_local"), named))
    # a generator instead of a filter, which the optimizer would push down and so read every value twice
    return rows.select("row_key", F.explode(F.array_compact(F.array(utc))).alias("utc_us"))
