import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from oracle import DATA

from ctilake.operators.timezones import estimate_zones, normalise_timestamps, zone_scores

U = dt.timezone.utc
SOURCES = [("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("none", None, "dmy"), ("odd", "Mars/Olympus", "dmy")]


def us(*a):
    d = dt.datetime(*a, tzinfo=U)
    return int((d - dt.datetime(1970, 1, 1, tzinfo=U)) / dt.timedelta(microseconds=1))


CASES = [
    ("2024-07-10T11:14:50.565057+00:00", "ny", us(2024, 7, 10, 11, 14, 50, 565057)),
    ("2024-07-10 11:14:50", "ny", us(2024, 7, 10, 15, 14, 50)),
    ("2024-01-10 11:14:50", "ny", us(2024, 1, 10, 16, 14, 50)),
    ("07/10/2024 01:05 PM", "ny", us(2024, 7, 10, 17, 5)),
    ("10/07/2024 12:05 AM", "de", us(2024, 7, 9, 22, 5)),
    ("23/04/2017 01:16 AM", "ny", None),
    ("1443890658", "de", us(2015, 10, 3, 16, 44, 18)),
    ("1443890658.250000", "de", us(2015, 10, 3, 16, 44, 18, 250000)),
    ("1581414142135", "de", us(2020, 2, 11, 9, 42, 22, 135000)),
    ("1352126994110677", "de", us(2012, 11, 5, 14, 49, 54, 110677)),
    ("20160423132243", "de", us(2016, 4, 23, 11, 22, 43)),
    ("20151113T080900Z", "ny", us(2015, 11, 13, 8, 9)),
    ("Tue, 30 Sep 2025 02:43:21 +0200", "ny", us(2025, 9, 30, 0, 43, 21)),
    ("Mon Oct 14 00:53:56 2024", "de", us(2024, 10, 13, 22, 53, 56)),
    ("Sun Sep 07, 2025 5:14 am", "ny", us(2025, 9, 7, 9, 14)),
    ("21 de agosto de 2012 03:41", "none", us(2012, 8, 21, 3, 41)),
    ("17. Januar 2024 20:31", "de", us(2024, 1, 17, 19, 31)),
    ("3 août 2021 17:10", "de", us(2021, 8, 3, 15, 10)),
    ("2008-02-22 06:54:45 CET", "ny", us(2008, 2, 22, 5, 54, 45)),
    ("2013-03-13 17:16:50 Asia/Kolkata", "de", us(2013, 3, 13, 11, 46, 50)),
    ("2013-03-13 17:16:50 America/New_York", "de", us(2013, 3, 13, 21, 16, 50)),
    ("2013-03-13 17:16:50 GMT+0545", "de", us(2013, 3, 13, 11, 31, 50)),
    ("2009-05-21", "de", us(2009, 5, 20, 22)),
    ("2023-10-29 02:30:00", "de", us(2023, 10, 29, 0, 30)),  # occurs twice: the first
    ("2023-03-26 02:30:00", "de", None),  # never occurs
    ("2025-02-30 16:30:00", "de", None),
    ("2009-13-29T00:00:00Z", "de", None),
    ("0000-00-00 00:00:00", "de", None),
    ("2024-01-01 25:00:00", "de", None),
    ("2024-01-01 10:00:00 XYZ", "de", None),
    ("2024-01-01 10:00:00", "odd", us(2024, 1, 1, 10)),
    ("2024-01-01 10:00:00", None, us(2024, 1, 1, 10)),
    ("2024-01-01 10:00:00", "unheard", us(2024, 1, 1, 10)),
    ("Yesterday, 22:13", "de", None), ("23 minutes ago", "de", None), ("N/A", "de", None), ("", "de", None), (None, "de", None), ("x" * 100_000, "de", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "src string, tz string, date_order string")


def test_notations(spark, sources):
    # extra columns named like those that the operator uses inside
    rows = [(i, v, s, "x", "y", 1) for i, (v, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k bigint, written string, src string, _tz string, source string, _local int")
    got = {r[0]: r[1] for r in normalise_timestamps(df, "k", "written", sources, "src").collect()}
    for i, (v, s, expected) in enumerate(CASES):
        assert got.get(i) == expected, (v, s)


def test_repeated_rows_and_empty_tables(spark, sources):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", "de")] * 3, "k bigint, written string, src string")
    assert normalise_timestamps(df, "k", "written", sources, "src").count() == 3
    assert normalise_timestamps(df.limit(0), "k", "written", sources, "src").count() == 0
    assert normalise_timestamps(df, "k", "written", sources.limit(0), "src").count() == 3


def test_zone_is_estimated_from_ingestion_order(spark, sources):
    """Rows of a source without a zone that would precede what they quote unless it keeps New York time."""
    rows = [(i, f"2024-03-{d:02d} {h:02d}:00:00", "none", us(2024, 3, d, h) + 3 * 3_600_000_000) for i, (d, h) in enumerate(itertools.product(range(1, 20), range(0, 20, 4)))]
    df = spark.createDataFrame(rows, "k bigint, written string, src string, seen bigint")
    scores = zone_scores(df, "written", sources, "src", not_before=F.col("seen"))
    best = {r["source"]: r["zone"] for r in estimate_zones(scores).collect()}
    assert best == {"none": "America/New_York"}
    got = {r[0]: r[1] for r in normalise_timestamps(df, "k", "written", sources, "src", not_before=F.col("seen")).collect()}
    assert got[0] == us(2024, 3, 1, 5)


def test_zone_is_estimated_from_sequence_order(spark, sources):
    """Every third row bears a Unix time; the rows between are in Chicago time, winter and summer."""
    chicago = [6, 5]  # hours behind UTC in January and in July
    rows = []
    for part, (month, behind) in enumerate(zip((1, 7), chicago)):
        for i in range(300):
            instant = us(2024, month, 1) + i * 1_800_000_000
            local = dt.datetime.fromtimestamp(instant / 1e6 - behind * 3600, U)
            rows.append((part * 1000 + i, str(instant // 1_000_000) if i % 3 == 0 else local.strftime("%Y-%m-%d %H:%M:%S"), "none"))
    df = spark.createDataFrame(rows, "k bigint, written string, src string")
    best = {r["source"]: r["zone"] for r in estimate_zones(zone_scores(df, "written", sources, "src", order=F.col("k"))).collect()}
    assert best == {"none": "America/Chicago"}
    got = {r[0]: r[1] for r in normalise_timestamps(df, "k", "written", sources, "src", order=F.col("k")).collect()}
    assert got[1] == us(2024, 1, 1, 0, 30) and got[1001] == us(2024, 7, 1, 0, 30)


def test_zone_is_estimated_from_load_times(spark, sources):
    """Rows loaded within minutes of being written, which no zone west of Tokyo allows."""
    rows = [(i, dt.datetime.fromtimestamp(us(2024, 3, 1) / 1e6 + i * 7000 + 9 * 3600, U).strftime("%Y-%m-%d %H:%M:%S"), "none", us(2024, 3, 1) + i * 7_000_000_000 + 60_000_000) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, written string, src string, seen bigint")
    kw = {"not_after": F.col("seen"), "not_before": F.col("seen") - 600_000_000}
    assert {r["zone"] for r in estimate_zones(zone_scores(df, "written", sources, "src", **kw)).collect()} == {"Asia/Tokyo"}


def test_session_zone_changes_nothing(spark, sources):
    from ctilake.functions.text import iso_timestamp
    from ctilake.plans.timestamps import p4_found

    found, iso = [], []
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append(p4_found(spark, DATA).agg(F.count(F.lit(1)), F.sum(F.xxhash64("tbl", "row_key", "utc_us").cast("decimal(38,0)"))).first())
            texts = spark.createDataFrame([("2024-01-02",), ("2024-01-02T03:04:05",), ("2024-01-02 03:04:05.5",), ("2024-01-02T03:04:05+01:00",), ("x",)], "t string")
            iso.append([r[0] for r in texts.select(F.unix_micros(iso_timestamp(F.col("t")))).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == found[2]
    assert iso[0] == iso[1] == iso[2] == [us(2024, 1, 2), us(2024, 1, 2, 3, 4, 5), us(2024, 1, 2, 3, 4, 5) + 500_000, us(2024, 1, 2, 2, 4, 5), None]
