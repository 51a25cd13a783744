"""Columns that take advisories, mails and listings apart: all native expressions over stored page text."""

from __future__ import annotations

import functools
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The mail headers that open a message.
MAIL_HEADERS = r"(?is)\A(?:(?:from|to|cc|date|subject|message-id|reply-to|list-id|in-reply-to|content-type|mime-version)\s*:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+[ \t]*\n?"
# Line breaks and entities of listing pages, in the order they are replaced.
LISTING_TEXT = [("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
AUTHOR_NOISE = [r"<[^>]+>", r"\([^)]*\)", r"=\?[^?]+\?[BbQq]\?[^?]+\?="]  # fixed values: address, comment and encoded word beside an author's name
KEV_SOURCE = "[Source: CISA Known Exploited Vulnerabilities Catalog]"  # fixed value: the closing line of the feed's texts


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def mail_body(text: Column) -> Column:
    """Message without leading headers, signature blocks and quoted lines, at most two blank lines in a row; empty for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), MAIL_HEADERS, "")
    t = F.regexp_replace(t, r"(?s)-----BEGIN PGP.*?(?:-----END PGP[^\n]*(?:\n|\z)|\z)", "")
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^[ \t]*>"))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), r"\n(?:[ \t]*\n){3,}", "\n\n\n"))


def header_field(text: Column, field: str) -> Column:
    """Value of a mail header with its continuation lines on one line; empty where there is none."""
    value = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^{field}[ \t]*:[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*)", 1)
    return trimmed(F.regexp_replace(value, r"[ \t\n]+", " "))


def author_name(raw: Column) -> Column:
    """Name without address, comment and encoded words; ``unknown`` where nothing is left."""
    for p in AUTHOR_NOISE:
        raw = trimmed(F.regexp_replace(raw, p, ""))
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(raw)


def key_value(text: Column, key: str) -> Column:
    """Value of the first ``key: value`` line, in any case; empty where there is none."""
    return trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^{key}[ \t]*:[ \t]*([^\n]+)$", 1))


def section_after(text: Column, heading: str) -> Column:
    """The section behind the last one that names ``heading``; sections are parted by lines of equal signs. Empty where there is none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n={3,}\n")
    following = F.transform(parts, lambda p, i: F.when(F.lower(p).contains(heading), F.coalesce(F.get(parts, i + 1), F.lit(""))))
    return trimmed(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.array_compact(following)), -1), F.lit("")))


def js_array(source: Column, schema: str) -> Column:
    """Array of objects out of JavaScript with bare keys and escaped quotes; null where it cannot be read."""
    repaired = F.regexp_replace(F.replace(source, F.lit("\\'"), F.lit("'")), r"([{,])\s*(\w+)\s*:", '$1"$2":')
    return F.from_json(repaired, f"array<struct<{schema}>>")


def listing_text(page: Column) -> Column:
    """Text of a listing page: breaks kept, tags as blanks, one blank for many, empty lines dropped."""
    for old, new in LISTING_TEXT:
        page = F.replace(page, F.lit(old), F.lit(new))
    lines = F.transform(F.split(F.regexp_replace(page, "<[^>]+>", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescaped_text(page: Column) -> Column:
    """Entities decoded first and tags removed then, runs of white space as one blank. Only texts with an entity leave the JVM."""
    page = F.when(page.contains("&"), _unescaped(page)).otherwise(page)
    return F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))


def listing_row(row: Column) -> list[Column]:
    """(id, title, date, severity, cves) of one row of an advisory listing."""
    get = lambda p: F.nullif(F.trim(F.regexp_extract(row, p, 1)), F.lit(""))
    severity = F.lower(get(r'(?i)class="[^"]*(critical|high|medium|low)'))
    cves = F.array_distinct(F.transform(F.regexp_extract_all(row, F.lit(r"(?i)(CVE-\d{4}-\d{4,7})"), F.lit(1)), F.upper))
    return [get(r"ssvid-(\d+)").alias("id"), get(r"(?s)<a[^>]*>([^<]*)</a>").alias("title"), get(r"(\d{4}-\d{2}-\d{2})").alias("day"), F.coalesce(severity, F.lit("unknown")).alias("severity"), F.array_join(cves, ",").alias("cves")]


def cards(page: Column) -> Column:
    """The cards of an advisory page as ``heading: text`` strings."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'(?s)<div class="card">(.*?)</div>'), F.lit(1))
    return F.transform(found, lambda c: F.concat(F.trim(F.regexp_extract(c, r"(?s)<h\d>(.*?)</h\d>", 1)), F.lit(": "), listing_text(F.regexp_replace(c, r"(?s)<h\d>.*?</h\d>", ""))))


def kev_text(name: Column, vendor: Column, product: Column, short: Column, action: Column, ransomware: Column, cwes: Column) -> Column:
    """Text of a known exploited vulnerability: the sections that have something to say, in order, under fixed headings."""
    filled = lambda c: c.isNotNull() & (c != "")
    affected = F.trim(F.concat_ws(" ", F.coalesce(vendor, F.lit("")), F.coalesce(product, F.lit(""))))
    parts = [F.when(filled(name), name), F.when(filled(vendor) | filled(product), F.concat(F.lit("Affected: "), affected)), F.when(filled(short), short), F.when(filled(action), F.concat(F.lit("Required Action: "), action)),
             F.when(filled(ransomware) & ~F.lower(ransomware).isin("unknown", "no"), F.concat(F.lit("Ransomware: "), ransomware)), F.when(F.size(cwes) > 0, F.concat(F.lit("CWE(s): "), F.array_join(cwes, ", "))), F.lit(KEV_SOURCE)]
    return F.concat_ws("\n\n", *parts)


def composed_date(year: Column, month: Column, day: Column, time: Column) -> Column:
    """``yyyy-mm-dd`` with the time where there is one, of string columns in which ``nan`` means missing; empty without a whole date."""
    there = lambda c: c.isNotNull() & ~c.isin("", "nan")
    two = lambda c: F.lpad(c.try_cast("int").cast("string"), 2, "0")
    date = F.concat_ws("-", year, two(month), two(day))
    whole = functools.reduce(lambda a, b: a & b, [there(c) for c in (year, month, day)])
    return F.when(whole, F.when(there(time), F.concat_ws(" ", date, time)).otherwise(date)).otherwise("")
