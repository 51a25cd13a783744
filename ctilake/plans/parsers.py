"""Parsers as queries. The tables hold no such pages, so each query makes its pages from the documents first, by fixed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.functions import advisories as A
from ctilake.functions import judge as J
from ctilake.functions.common import filled, n_rows
from ctilake.plans.evaluation import cyrillic_share
from ctilake.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filled().alias("t"), "source", "cve_refs", F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")).alias("day"))


def _key(name: str = "doc_id"):
    return F.col(name).cast("string")


def mail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, author and cleaned body of every document framed as a mail with headers, a quotation and a signature block."""
    page = F.concat(F.lit("From: Ann "), F.col("source"), F.lit(" (list) <a@b.example>\nSubject: note\n  on "), _key(), F.lit("\nDate: "), F.col("day"), F.lit("\n\n"), F.col("t"), F.lit("\n> said\n\n\n\n\nend\n-----BEGIN PGP SIGNATURE-----\nabc\n-----END PGP SIGNATURE-----\n"))
    mails = _docs(spark, sf_dir).select("doc_id", page.alias("m"))
    return mails.select("doc_id", A.header_field(F.col("m"), "subject").alias("subject"), A.author_name(A.header_field(F.col("m"), "from")).alias("author"), F.md5(A.mail_body(F.col("m"))).alias("body_md5"))


def advisory_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release date, score and the sections behind two headings of every document framed as an advisory."""
    page = F.concat(F.lit("Document Title:\n===\n"), F.col("source"), F.lit("\nRelease Date:  "), F.col("day"), F.lit("\nCVSS Score : "), (F.col("doc_id") % 10).cast("string"), F.lit("\nTechnical Details & Description:\n===\n"), F.col("t"), F.lit("\n===\nProof of Concept (PoC):\n=====\nrun "), _key(), F.lit("\n====\nCredits\n"))
    pages = _docs(spark, sf_dir).select("doc_id", page.alias("p"))
    return pages.select("doc_id", A.key_value(F.col("p"), "release date").alias("released"), A.key_value(F.col("p"), "cvss score").alias("score"), F.md5(A.section_after(F.col("p"), "description")).alias("description_md5"), A.section_after(F.col("p"), "proof of concept").alias("poc"))


def script_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index written as a JavaScript array with bare keys."""
    page = F.concat(F.lit('[{id:"ZSL-'), _key(), F.lit('",title:"it\\\'s '), F.col("source"), F.lit('", n: '), (F.col("doc_id") % 7).cast("string"), F.lit('},{id:"X-'), _key(), F.lit('",title:"b",n:2}]'))
    return _docs(spark, sf_dir).select("doc_id", F.explode(A.js_array(page, "id string, title string, n int")).alias("e")).select("doc_id", "e.id", "e.title", "e.n")


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, title, day, severity and identifiers of every document framed as a row of an advisory listing."""
    level = F.get(F.array(*map(F.lit, ("critical", "high", "medium", "low", "none"))), (F.col("doc_id") % 5).cast("int"))
    row = F.concat(F.lit('<tr><td><a href="/ssvid-'), _key(), F.lit('">'), F.col("source"), F.lit("</a></td><td>"), F.col("day"), F.lit('</td><td class="vul-level '), level, F.lit('">'), F.coalesce(F.array_join("cve_refs", " "), F.lit("")), F.lit("</td></tr>"))
    return _docs(spark, sf_dir).select("doc_id", *A.listing_row(row))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of raw bodies that hold markup, with their lines kept."""
    raw = table(spark, sf_dir, "raw_posts").filter(F.col("body").contains("<") | F.col("body").contains("&"))
    return raw.select("row_id", F.md5(A.listing_text(F.col("body"))).alias("text_md5"))


def advisory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and texts of the cards of a page made from every document's source and day."""
    page = F.concat(F.lit('<div class="card"><h5>Vendor</h5><p>'), F.col("source"), F.lit('<br>Ltd &amp; Co</p></div><div class="card"><h5>Date</h5> '), F.col("day"), F.lit("</div>"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(A.cards(page)).alias("i", "card"))


def kev_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled text of every document as an entry of a feed of exploited vulnerabilities."""
    k = F.col("doc_id")
    when = lambda m, c: F.when(k % m != 0, c)
    text = A.kev_text(when(3, F.col("source")), when(4, F.lit("Acme")), when(5, F.lit("Router")), F.substring("t", 1, 100), when(2, F.lit("Apply updates.")), F.when(k % 3 == 0, "Known").when(k % 3 == 1, "Unknown"), F.coalesce(F.when(k % 2 == 0, F.array(F.lit("CWE-79"), F.lit("CWE-20"))), F.array().cast("array<string>")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("chars"))


def composed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates put together from the parts of every document's day, some of them missing."""
    part = lambda i: F.element_at(F.split("day", "-"), i)
    dated = _docs(spark, sf_dir).filter("day <> ''")
    return dated.select("doc_id", A.composed_date(part(1), F.when(F.col("doc_id") % 9 == 0, "nan").otherwise(part(2)), part(3), F.when(F.col("doc_id") % 2 == 0, "10:20").otherwise("nan")).alias("written"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking tokens, Cyrillic share, and the text cut to several lengths with a marker, of every post."""
    t = filled()
    toks = F.regexp_extract_all(F.lower(t), F.lit(r"([A-Za-z0-9_./:-]{2,})"), F.lit(1))
    return table(spark, sf_dir, "forum_posts").select("post_key", F.size(toks).alias("tokens"), F.round(cyrillic_share(t), 6).alias("cyrillic"), F.md5(J.truncated(t, 500)).alias("cut_500"), *[F.length(F.substring(t, 1, n)).alias(f"chars_{n}") for n in (384, 512, 1000, 2000, 2048, 4000, 4096, 8000)])


def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bodies that are block pages, by forum."""
    from ctilake.sources.html import blocked

    return table(spark, sf_dir, "raw_posts").groupBy("forum_id").agg(n_rows().alias("n"), F.count_if(blocked(F.col("body"))).alias("blocked"))


QUERIES = {f.__name__: f for f in (mail_messages, advisory_sections, script_index, listing_rows, page_texts, advisory_cards, kev_entries, composed_dates, text_measures, blocked_pages)}

_d = "(select doc_id, coalesce(text, '') as t, source, cve_refs, coalesce(strftime(published_at, '%Y-%m-%d'), '') as day from documents)"
_trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = {
    "mail_messages": rf"""with m as (select doc_id, 'note on ' || doc_id::varchar as subject, 'Ann ' || source as author, t || chr(10) || '> said' || repeat(chr(10), 5) || 'end' || chr(10) || '-----BEGIN PGP SIGNATURE-----' || chr(10) || 'abc' || chr(10) || '-----END PGP SIGNATURE-----' || chr(10) as b from {_d}),
p as (select doc_id, subject, author, regexp_replace(b, '(?s)-----BEGIN PGP.*?(?:-----END PGP[^\n]*(?:\n|\z)|\z)', '', 'g') as b from m), l as (select doc_id, subject, author, array_to_string(list_filter(string_split(b, chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')), chr(10)) as b from p)
select doc_id, subject, author, md5({_trim.format(r"regexp_replace(b, '\n(?:[ \t]*\n){3,}', chr(10) || chr(10) || chr(10), 'g')")}) as body_md5 from l""",
    "advisory_sections": rf"""with p as (select doc_id, day, t, 'Document Title:' || chr(10) || '===' || chr(10) || source || chr(10) || 'Release Date:  ' || day || chr(10) || 'CVSS Score : ' || (doc_id % 10)::varchar || chr(10) || 'Technical Details & Description:' || chr(10) || '===' || chr(10) || t || chr(10) || '===' || chr(10) || 'Proof of Concept (PoC):' || chr(10) || '=====' || chr(10) || 'run ' || doc_id::varchar || chr(10) || '====' || chr(10) || 'Credits' || chr(10) as p from {_d}),
s as (select *, regexp_split_to_array(p, '\n={{3,}}\n') as s from p), h as (select *, list_filter(range(1, len(s) + 1), lambda i: contains(lower(s[i]), 'description')) as a, list_filter(range(1, len(s) + 1), lambda i: contains(lower(s[i]), 'proof of concept')) as b from s)
select doc_id, {_trim.format("regexp_extract(p, '(?im)^release date[ \\t]*:[ \\t]*([^\\n]+)$', 1)")} as released, {_trim.format("regexp_extract(p, '(?im)^cvss score[ \\t]*:[ \\t]*([^\\n]+)$', 1)")} as score, md5({_trim.format("coalesce(s[a[-1] + 1], '')")}) as description_md5, {_trim.format("coalesce(s[b[-1] + 1], '')")} as poc from h""",
    "script_index": "select doc_id, 'ZSL-' || doc_id::varchar as id, 'it''s ' || source as title, (doc_id % 7)::int as n from documents union all select doc_id, 'X-' || doc_id::varchar, 'b', 2 from documents",
    "listing_rows": f"select doc_id, doc_id::varchar as id, source as title, nullif(day, '') as day, ['critical', 'high', 'medium', 'low', 'unknown'][doc_id % 5 + 1] as severity, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(array_to_string(cve_refs, ' '), ''), '(?i)CVE-\\d{{4}}-\\d{{4,7}}'), lambda x: struct_pack(p := list_position(list_transform(regexp_extract_all(array_to_string(cve_refs, ' '), '(?i)CVE-\\d{{4}}-\\d{{4,7}}'), lambda y: upper(y)), upper(x)), c := upper(x))))), lambda x: x.c), ','), '') as cves from {_d}",
    "page_texts": r"""with r as (select row_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(body, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as b from raw_posts where contains(body, '<') or contains(body, '&'))
select row_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(b, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) as text_md5 from r""",
    "advisory_cards": f"select doc_id, 0 as i, 'Vendor: ' || source || chr(10) || 'Ltd & Co' as card from {_d} union all select doc_id, 1, 'Date: ' || day from {_d}",
    "kev_entries": f"""with r as (select doc_id, concat_ws(chr(10) || chr(10), case when doc_id % 3 <> 0 then source end, case when doc_id % 4 <> 0 and doc_id % 5 <> 0 then 'Affected: Acme Router' when doc_id % 4 <> 0 then 'Affected: Acme' when doc_id % 5 <> 0 then 'Affected: Router' end, nullif(substr(t, 1, 100), ''), case when doc_id % 2 <> 0 then 'Required Action: Apply updates.' end,
case when doc_id % 3 = 0 then 'Ransomware: Known' end, case when doc_id % 2 = 0 then 'CWE(s): CWE-79, CWE-20' end, '[Source: CISA Known Exploited Vulnerabilities Catalog]') as x from {_d}) select doc_id, md5(x) as text_md5, length(x)::int as chars from r""",
    "composed_dates": f"select doc_id, case when doc_id % 9 = 0 then '' when doc_id % 2 = 0 then day || ' 10:20' else day end as written from {_d} where day <> ''",
    "text_measures": r"select post_key, len(regexp_extract_all(lower(t), '[A-Za-z0-9_./:-]{2,}'))::int as tokens, round(case when t = '' then 0 else (length(t) - length(regexp_replace(t, '[\x{0400}-\x{04FF}]', '', 'g')))::double / length(t) end, 6) as cyrillic, md5(case when length(t) > 500 then substr(t, 1, 500) || '...[truncated]' else t end) as cut_500, " + ", ".join(f"least(length(t), {n})::int as chars_{n}" for n in (384, 512, 1000, 2000, 2048, 4000, 4096, 8000)) + " from (select post_key, coalesce(text, '') as t from forum_posts)",
    "blocked_pages": "select forum_id, count(*) as n, count(*) filter (regexp_matches(lower(coalesce(body, '')), 'just a moment|verify you are human|checking your browser|cf-browser-verification|why do i have to complete a captcha|attention required! \\| cloudflare')) as blocked from raw_posts group by 1",
}
