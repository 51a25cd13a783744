"""Column expressions that read mixed timestamp notations.

Everything here is built from native expressions, so a scan that normalises timestamps stays in
one generated stage; no value passes through Python.
"""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and short forms of the languages in use, lower case.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "jän": 1, "mär": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "gennaio": 1, "febbraio": 2, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "settembre": 9, "ottobre": 10, "dicembre": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "maio": 5, "junho": 6, "julho": 7, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12, "novembre": 11,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
    "ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12,
}

# Zone abbreviations and their offset from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "HKT": 480,
    "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "COT": -300, "BRT": -180,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?:\s*(Z|(?:UTC|GMT)?\s?[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+|[A-Z]{2,5}))?"
# Every notation: a pattern, and where its groups go in year|month|day|hour|minute|second|fraction|half of day|zone.
# In the third, N and M stand for the two leading numbers, whose meaning depends on the source.
NOTATIONS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt,]?\s*{_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$N|$M|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th)?\s+(?:de\s+)?(\p{{L}}+)\.?,?\s+(?:de\s+)?(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^\p{{L}}+\.?,?\s+(\p{{L}}+)\.?\s+(\d{{1,2}})\s+{_CLOCK}(?:\s+([A-Z]{{2,5}}|[+-]\d{{2}}:?\d{{2}}))?\s+(\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8"),
]
_EPOCH = r"^(\d{10}|\d{13}|\d{16})(?:\.(\d{1,6})\d*)?$"


def _map(values: dict) -> Column:
    """A literal map, parsed from one SQL text: building it from columns costs a call to the JVM per entry."""
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")


@functools.cache
def known_zones() -> list[str]:
    """Zone names that the JVM's time zone database can resolve, as one SQL list."""
    names = SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds().toString()
    return sorted(x for x in names.strip("[]").split(", ") if re.fullmatch(r"[\w/+\-]+", x))


def is_known_zone(name: str) -> Column:
    """Whether the column ``name`` holds a zone that can be resolved; null for null."""
    return F.expr(f"{name} in (" + ", ".join(f"'{z}'" for z in known_zones()) + ")")


def tidy(value: Column) -> Column:
    """``value`` with single blanks and without blanks around it."""
    return F.trim(F.regexp_replace(value, r"[\s\x{00A0}]+", " "))


def fields(tidied: Column, order: Column) -> Column:
    """The fields written in a tidied value as an array of nine strings; null when no notation fits.

    Year, month, day, hour, minute, second, fraction, half of the day, zone; a missing one is
    empty. ``order`` is ``dmy`` or ``mdy`` and decides all-numeric dates that do not begin with
    the year (null counts as ``dmy``). The array is not cheap, so the optimizer computes it once
    and later projections only take its elements.
    """
    out = F.lit(None).cast("string")
    for pattern, to in reversed(NOTATIONS):
        if "$N" in to:
            dmy, mdy = to.replace("$N", "$2").replace("$M", "$1"), to.replace("$N", "$1").replace("$M", "$2")
            text = F.regexp_replace(tidied, F.lit(pattern), F.when(order == "mdy", mdy).otherwise(dmy))
        else:
            text = F.regexp_replace(tidied, pattern, to)
        out = F.when(tidied.rlike(pattern), text).otherwise(out)
    return F.split(out, r"\|", 9)


def epoch_us(tidied: Column) -> Column:
    """Microseconds of a Unix time in seconds (with or without a fraction), milliseconds or microseconds."""
    whole, frac = F.regexp_extract(tidied, _EPOCH, 1), F.rpad(F.regexp_extract(tidied, _EPOCH, 2), 6, "0")
    digits = F.length(whole)
    return F.when(digits > 0, F.rpad(whole, 16, "0").cast("long") + F.when(digits == 10, frac.cast("long")).otherwise(0))


def wall_clock_us(f: Column) -> Column:
    """Microseconds of the written wall clock as if it stood in UTC; null for impossible dates and times."""
    num = lambda i: F.expr("null").cast("int") if i is None else F.nullif(f[i], F.lit("")).try_cast("int")
    month = F.coalesce(num(1), F.try_element_at(_map(MONTHS), F.lower(f[1])))
    day = F.unix_micros(F.try_make_timestamp(num(0), month, num(2), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    written, half = num(3), F.lower(f[7])
    hour = F.when(half == "", F.coalesce(written, F.lit(0))).when(written.between(1, 12), written % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = F.coalesce(num(4), F.lit(0)), F.coalesce(num(5), F.lit(0))
    frac = F.rpad(F.substring(f[6], 1, 6), 6, "0").cast("long")
    fits = hour.between(0, 23) & (minute < 60) & (second < 60)
    return F.when(fits, day + ((hour * 60 + minute) * 60 + second).cast("long") * 1_000_000 + frac)


def explicit_offset_us(zone: Column) -> Column:
    """Offset in microseconds of ``+hh:mm``, ``GMT+hhmm`` or a known abbreviation; null otherwise."""
    pattern = r"^(?:UTC|GMT)?\s?([+-])(\d{2}):?(\d{2})$"
    minutes = (F.regexp_extract(zone, pattern, 2).cast("int") * 60 + F.regexp_extract(zone, pattern, 3).cast("int")) * F.when(F.regexp_extract(zone, pattern, 1) == "-", -1).otherwise(1)
    fits = F.regexp_extract(zone, pattern, 3).cast("int").between(0, 59) & F.regexp_extract(zone, pattern, 2).cast("int").between(0, 18)
    return F.when(zone.rlike(pattern), F.when(fits, minutes)).otherwise(F.try_element_at(_map(ABBREVIATIONS), zone)).cast("long") * 60_000_000


def local_to_utc_us(local_us: Column, zone: Column) -> Column:
    """UTC microseconds of a wall clock in a named zone.

    A wall clock that occurs twice means the first; one that never occurs gives null. Independent
    of the session's time zone.
    """
    local = F.timestamp_micros(local_us)
    utc = F.to_utc_timestamp(local, zone)
    return F.when(F.unix_micros(F.from_utc_timestamp(utc, zone)) == local_us, F.unix_micros(utc))
