"""Benchmark tasks built from posts, links and records: texts, labels, splits, reasons for leaving rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.functions import text as X
from ctilake.functions.common import filled, n_rows
from ctilake.operators.sampling import per_stratum_counts, top_of_strata
from ctilake.plans.splits import _family
from ctilake.sources.tables import broadcast_if_small, table

LEAST_QUERY = 20
ATTEMPTS = 20

# Kinds of exploit that archives and bounty programmes use, and the class they stand for.
TYPE_CLASSES = {
    "remote": "rce", "local": "auth_access", "dos": "dos", "webapps": "injection", "shellcode": "memory_corruption",
    "sql injection": "injection", "cross-site scripting": "xss", "path traversal": "file_inclusion", "information disclosure": "info_disclosure", "privilege escalation": "auth_access",
}


def year_split(value: Column, train_before: int = 2020, val_before: int = 2023) -> Column:
    """Split by the first run of four digits that is a year from 1990 to 2030; rows without one train."""
    year = F.regexp_extract(F.coalesce(value, F.lit("")), r"(\d{4})", 1).try_cast("int")
    year = F.when(year.between(1990, 2030), year)
    return F.when(year.isNull() | (year < train_before), "train").when(year < val_before, "val").otherwise("test")


def typed_class(kind: Column, title: Column) -> Column:
    """Class of a declared type; of the title, without a ``[Type]`` prefix, where the type says nothing."""
    look = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPE_CLASSES.items()) + ")")
    bare = F.regexp_replace(title, r"^\s*\[[^\]]*\]\s*", "")
    return F.coalesce(F.try_element_at(look, F.lower(F.trim(kind))), X.title_class(bare))


def linkage_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the linkage task with the reason a row is left out, its query text's length and its split.

    A text that is too short falls back to the title; the gold must exist; the split goes by the date,
    by the identifier's year where there is none, else it is test.
    """
    golds = table(spark, sf_dir, "ev_pairs").filter("vulnerability_text is not null").select(_family("cve_id").alias("family")).distinct()
    items = table(spark, sf_dir, "task1_cve_linkage").select("item_id", "cve_id", "timestamp", F.trim(filled()).alias("t"), F.trim(filled("title")).alias("title"), _family("cve_id").alias("family"))
    query = F.substring(F.when(F.length("t") >= LEAST_QUERY, F.col("t")).otherwise(F.col("title")), 1, 4000)
    year = X.cve_year(F.col("cve_id"))
    by_year = F.when(year < 2022, "train").when(year < 2024, "val").otherwise("test")
    out = items.join(golds.withColumn("has_gold", F.lit(True)), "family", "left").withColumn("q", query)
    reason = F.when(F.col("has_gold").isNull(), "no_gold").when(F.length("q") < 10, "empty_or_short_query").otherwise("kept")
    return out.select("item_id", reason.alias("reason"), F.length("q").alias("chars"), F.coalesce(X.date_split(X.iso_date(F.col("timestamp"))), by_year).alias("new_split"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the linkage task by reason and split."""
    return linkage_task(spark, sf_dir).groupBy("reason", "new_split").agg(n_rows().alias("n"))


def signal_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with and without an indexed identifier: positives by semi join, negatives by anti join that name none, balanced.

    In every source and split as many of either as the rarer has, at most 50, from sources with at
    least five positives and one negative; then at most twice as many negatives as positives a split.
    """
    docs = table(spark, sf_dir, "documents")
    index = docs.select(F.explode("cve_refs").alias("cve_id"), "doc_id").filter("cve_id is not null").select("doc_id").distinct()
    split = F.coalesce(X.date_split(F.to_date("published_at")), F.lit("train"))
    rows = docs.select("doc_id", "source", split.alias("split"), filled().alias("t"))
    positive = rows.join(index, "doc_id", "left_semi").select("doc_id", "source", "split", F.lit(1).alias("label"))
    negative = rows.join(index, "doc_id", "left_anti").filter(~F.col("t").rlike(r"(?i)CVE-\d{4}-\d{4,7}")).select("doc_id", "source", "split", F.lit(0).alias("label"))
    both = positive.unionByName(negative)
    sizes = both.groupBy("source", "split").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).filter("p >= 5 and n >= 1").select("source", "split", F.least("p", "n", F.lit(50)).alias("_m"))
    chosen = top_of_strata(both, sizes, ["source", "split"], ["label"], "doc_id", "_m", most=50)
    limits = chosen.groupBy("split").agg((2 * F.count_if(F.col("label") == 1)).alias("_m"))
    return per_stratum_counts(chosen, limits, "split", "label", "doc_id")


def class_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources in order of priority, the first of every text kept, with class and split by year.

    The class is that of the declared type, then of the title; rows without either are left out.
    """
    first = lambda c: F.regexp_extract(filled(c), r"^([^\n]*)", 1)
    records = table(spark, sf_dir, "task2_exploit_type").select(F.lit(0).alias("rank"), F.col("rec_id").alias("key"), filled().alias("t"), X.title_class(first("text")).alias("label"), "timestamp")
    pairs = table(spark, sf_dir, "ev_pairs").select(F.lit(1).alias("rank"), F.col("pair_id").alias("key"), filled("exploit_text").alias("t"), X.title_class(first("exploit_text")).alias("label"), "timestamp")
    kind = F.regexp_extract(filled(), r"(?i)\btype: *([a-z -]+)", 1)
    docs = table(spark, sf_dir, "documents").select(F.lit(2).alias("rank"), F.col("doc_id").alias("key"), filled().alias("t"), typed_class(kind, first("text")).alias("label"), F.date_format("published_at", "yyyy-MM-dd").alias("timestamp"))
    rows = records.unionByName(pairs).unionByName(docs).filter("label is not null and trim(t) <> ''").withColumn("fp", X.fingerprint(F.substring("t", 1, 8000)))
    kept = rows.groupBy("fp").agg(F.min_by(F.struct("rank", "key", "label", "timestamp"), F.struct("rank", "key")).alias("k"))
    return kept.select("k.rank", "k.key", "k.label", year_split(F.col("k.timestamp")).alias("split"))


def cve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every post id, upper case, in order of first mention, each once."""
    rows = table(spark, sf_dir, "task1_cve_linkage").filter("id is not null and cve_id is not null")
    one = rows.select("id", F.upper(F.trim(F.substring_index("cve_id", ";", 1))).alias("cve"), "item_id").groupBy("id", "cve").agg(F.min("item_id").alias("at"))
    return one.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cve"))), lambda x: x["cve"]), ",").alias("cves"))


def looked_up_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every mention by the linked item's date, else by its own, else train."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "published_at", F.explode(F.array_distinct(F.transform("cve_refs", _family))).alias("family"))
    items = table(spark, sf_dir, "task1_cve_linkage").filter("cve_id is not null").groupBy(_family("cve_id").alias("family")).agg(F.min_by(X.iso_date(F.col("timestamp")), "item_id").alias("day"))
    day = F.coalesce("day", F.to_date("published_at"))
    return docs.join(items, "family", "left").select("doc_id", "family", F.coalesce(X.date_split(day), F.lit("train")).alias("split"))


def positive_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One positive pair for every identifier of a document that a vulnerability text describes: (doc_id, family, pair_id)."""
    mentions = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform("cve_refs", _family))).alias("family"))
    known = table(spark, sf_dir, "ev_pairs").filter("cve_id is not null and vulnerability_text is not null").groupBy(_family("cve_id").alias("family")).agg(F.min("pair_id").alias("pair_id"))
    return mentions.join(known, "family").select("doc_id", "family", "pair_id")


def negative_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every positive pair a described identifier that the document does not mention: (doc_id, family, negative).

    Identifiers are numbered in name order; a pair draws up to ATTEMPTS numbers by hash and takes the
    first whose identifier its document does not have. A pair whose draws all fail gets none, as in
    an attempt-capped draw; draws meet the numbers by an equality join, so no pair is crossed with
    all identifiers.
    """
    positive = positive_pair_rows(spark, sf_dir)
    names = table(spark, sf_dir, "ev_pairs").filter("cve_id is not null and vulnerability_text is not null").select(_family("cve_id").alias("negative")).distinct()
    total = names.count()
    if not total:
        return positive.select("doc_id", "family", F.lit(None).cast("string").alias("negative")).limit(0)
    numbered = spark.createDataFrame(names.orderBy("negative").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), "negative string, number bigint")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "family", F.col("attempt").cast("string"))), 1, 8), 16, 10).cast("bigint") % total
    drawn = positive.select("doc_id", "family", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))).alias("attempt")).withColumn("number", draw).join(numbered, "number")
    allowed = drawn.join(positive.select("doc_id", F.col("family").alias("negative")), ["doc_id", "negative"], "left_anti")
    return allowed.groupBy("doc_id", "family").agg(F.min_by("negative", "attempt").alias("negative"))


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records left-joined with the metadata of their source, and those whose id an earlier source has left out."""
    meta = broadcast_if_small(table(spark, sf_dir, "unified_stats").groupBy(F.regexp_replace("source_dataset", "_posts$", "").alias("source")).agg(F.sum("written_rows").alias("written")))
    records = table(spark, sf_dir, "task2_exploit_type").select("rec_id", "id", "source")
    earlier = table(spark, sf_dir, "task1_cve_linkage").select("id").union(records.filter("source = 'exploitdb'").select("id")).distinct()
    rest = records.filter("source = 'exploitdb'").unionByName(records.filter("source <> 'exploitdb'").join(earlier, "id", "left_anti"))
    return rest.join(meta, "source", "left").groupBy("source").agg(n_rows().alias("n"), F.count("written").alias("with_metadata"))


QUERIES = {f.__name__: f for f in (linkage_task, skip_reasons, signal_task, class_task, cve_lookup, looked_up_split, positive_pair_rows, negative_pair_rows, metadata_join)}

_fam = lambda c: f"(substr({c}, 1, 9) || (try_cast(substr({c}, 10, 20) as bigint) % 20)::varchar)"
_by_date = lambda d: f"case when {d} < date '2022-01-01' then 'train' when {d} < date '2024-01-01' then 'val' when {d} is not null then 'test' end"
_iso = lambda c: rf"case when regexp_matches(substr({c}, 1, 10), '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(substr({c}, 1, 10) as date) end"
_linkage = rf"""with g as (select distinct {_fam('cve_id')} as f from ev_pairs where vulnerability_text is not null), i as (select item_id, cve_id, timestamp, {_fam('cve_id')} as f, substr(case when length(trim(coalesce(text, ''), ' ')) >= 20 then trim(coalesce(text, ''), ' ') else trim(coalesce(title, ''), ' ') end, 1, 4000) as q from task1_cve_linkage),
l as (select item_id, case when g.f is null then 'no_gold' when length(q) < 10 then 'empty_or_short_query' else 'kept' end as reason, length(q)::int as chars,
coalesce({_by_date(_iso('timestamp'))}, case when try_cast(regexp_extract(cve_id, '^CVE-(\d{{4}})-', 1) as int) < 2022 then 'train' when try_cast(regexp_extract(cve_id, '^CVE-(\d{{4}})-', 1) as int) < 2024 then 'val' else 'test' end) as new_split from i left join g on i.f = g.f)"""
# The classes of titles, written out for the check: the first group with a match decides.
_title = lambda p: f"""case when regexp_matches({p}, 'remote code execution|rce|arbitrary code execution|deserialization') then 'rce'
when regexp_matches({p}, 'buffer overflow|stack overflow|heap overflow|use-after-free|use after free|integer overflow|type confusion|null pointer|out-of-bounds|out of bounds|memory corruption|format string') then 'memory_corruption'
when regexp_matches({p}, 'sql injection|sqli|blind sql|command injection|os command|code injection|ssti|template injection|ldap injection|xml injection|xxe|xpath injection|header injection|crlf injection|email injection|expression language|request smuggling') then 'injection'
when regexp_matches({p}, 'cross-site scripting|xss|html injection|script injection') then 'xss' when regexp_matches({p}, 'denial of service| dos|crash|resource exhaustion|infinite loop') then 'dos'
when regexp_matches({p}, 'file inclusion|lfi|rfi|path traversal|directory traversal|arbitrary file|file upload|file read|file write|file delete|file download|unrestricted upload') then 'file_inclusion'
when regexp_matches({p}, 'privilege escalation|privesc|authentication bypass|auth bypass|access control|idor|csrf|cross-site request forgery|session fixation|session hijack|broken auth|improper auth|permission|unauthorized') then 'auth_access' when contains({p}, 'code execution') then 'rce'
when regexp_matches({p}, 'information disclosure|info disclosure|information leak|ssrf|server-side request forgery|open redirect|redirect|cleartext|sensitive data|exposure|enumeration') then 'info_disclosure' end"""  # noqa: E731
_part = lambda c: f"lower(case when instr({c}, ' - ') > 0 then substr({c}, instr({c}, ' - ') + 3) else {c} end)"
_first = lambda c: f"split_part(coalesce({c}, ''), chr(10), 1)"
_types = "case trim(lower(regexp_extract(coalesce(text, ''), '(?i)\\btype: *([a-z -]+)', 1)), ' ') " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_CLASSES.items()) + " end"
_pos = f"""m as (select distinct doc_id, {_fam('c')} as family from (select doc_id, unnest(cve_refs) as c from documents)), k as (select {_fam('cve_id')} as family, min(pair_id) as pair_id from ev_pairs where cve_id is not null and vulnerability_text is not null group by 1),
p as (select doc_id, m.family, pair_id from m join k on m.family = k.family)"""
SQL = {
    "linkage_task": f"{_linkage} select * from l",
    "skip_reasons": f"{_linkage} select reason, new_split, count(*) as n from l group by 1, 2",
    "signal_task": rf"""with r as (select doc_id, source, coalesce({_by_date('published_at::date')}, 'train') as split, case when len(list_filter(cve_refs, lambda x: x is not null)) > 0 then 1 when not regexp_matches(coalesce(text, ''), '(?i)CVE-\d{{4}}-\d{{4,7}}') then 0 end as label from documents),
s as (select source, split, least(count(*) filter (label = 1), count(*) filter (label = 0), 50) as m from r where label is not null group by 1, 2 having count(*) filter (label = 1) >= 5 and count(*) filter (label = 0) >= 1),
a as (select r.*, row_number() over (partition by r.source, r.split, label order by md5('42|' || doc_id::varchar), doc_id) as rn, m from r join s on r.source = s.source and r.split = s.split where label is not null),
b as (select * from a where rn <= m), c as (select doc_id, source, split, label, row_number() over (partition by split, label order by md5('42|' || doc_id::varchar), doc_id) as rn, 2 * sum(label) over (partition by split) as most from b)
select doc_id, source, split, label from c where label = 1 or rn <= most""",
    "class_task": rf"""with r as (select 0 as rank, rec_id as key, coalesce(text, '') as t, {_title(_part(_first('text')))} as label, timestamp from task2_exploit_type
union all select 1, pair_id, coalesce(exploit_text, ''), {_title(_part(_first('exploit_text')))}, timestamp from ev_pairs
union all select 2, doc_id, coalesce(text, ''), coalesce({_types}, {_title(_part(r"regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '^\s*\[[^\]]*\]\s*', '')"))}), strftime(published_at, '%Y-%m-%d') from documents),
k as (select *, try_cast(regexp_extract(coalesce(timestamp, ''), '(\d{{4}})', 1) as int) as y, row_number() over (partition by trim(regexp_replace(lower(substr(t, 1, 8000)), '[ \t\n\r\f\x0B]+', ' ', 'g')) order by rank, key) as rn from r where label is not null and trim(t, ' ') <> '')
select rank, key, label, case when y is null or y not between 1990 and 2030 or y < 2020 then 'train' when y < 2023 then 'val' else 'test' end as split from k where rn = 1""",
    "cve_lookup": "with r as (select id, upper(trim(split_part(cve_id, ';', 1), ' ')) as cve, min(item_id) as first from task1_cve_linkage where id is not null and cve_id is not null group by 1, 2) select id, string_agg(cve, ',' order by first, cve) as cves from r group by 1",
    "looked_up_split": f"""with d as (select distinct doc_id, published_at, {_fam('c')} as family from (select doc_id, published_at, unnest(cve_refs) as c from documents)), i as (select {_fam('cve_id')} as family, arg_min({{'d': {_iso('timestamp')}}}, item_id).d as day from task1_cve_linkage where cve_id is not null group by 1)
select doc_id, d.family, coalesce({_by_date('coalesce(day, published_at::date)')}, 'train') as split from d left join i on d.family = i.family""",
    "positive_pair_rows": f"with {_pos} select * from p",
    "negative_pair_rows": f"""with {_pos}, n as (select family as negative, row_number() over (order by family) - 1 as number, count(*) over () as total from k),
d as (select doc_id, family, a, ('0x' || substr(md5(doc_id::varchar || '|' || family || '|' || a::varchar), 1, 8))::bigint % (select max(total) from n) as number from p, range(20) t(a)),
x as (select d.doc_id, d.family, negative, a from d join n on d.number = n.number where not exists (select 1 from p where p.doc_id = d.doc_id and p.family = negative)) select doc_id, family, arg_min(negative, a) as negative from x group by 1, 2""",
    "metadata_join": """with m as (select regexp_replace(source_dataset, '_posts$', '') as source, sum(written_rows) as w from unified_stats group by 1), e as (select id from task1_cve_linkage union select id from task2_exploit_type where source = 'exploitdb'),
r as (select * from task2_exploit_type t where source = 'exploitdb' or (source <> 'exploitdb' and not exists (select 1 from e where e.id = t.id))) select r.source, count(*) as n, count(w) as with_metadata from r left join m on r.source = m.source group by 1""",
}
