"""Deduplication, unification and audit queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions.common import n_rows
from ctilake.functions import text as X
from ctilake.operators.dedup import keep_first, keep_priority
from ctilake.sources.tables import broadcast_if_small, table

BIG = "bigint"


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "forum_posts")


def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First post of every text, with the text's fingerprint and number of rows."""
    rows = _posts(spark, sf_dir).select("post_key", X.normal(F.col("text")).alias("n")).filter("n <> ''").select("post_key", F.sha2("n", 256).alias("fp"))
    return rows.groupBy("fp").agg(F.min("post_key").alias("post_key"), n_rows().alias("n_rows"))


def dedup_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input, written, duplicate and empty rows of every source, first row over all sources kept."""
    rows = _posts(spark, sf_dir).select("post_key", "source_dataset", X.normal(F.coalesce("text", F.lit(""))).alias("n"))
    rows = rows.select("post_key", "source_dataset", F.when(F.col("n") != "", F.sha2("n", 256)).alias("fp"))
    first = rows.filter("fp is not null").groupBy("fp").agg(F.min_by("source_dataset", "post_key").alias("source_dataset"))
    written = first.groupBy("source_dataset").agg(n_rows().alias("written"))
    counts = rows.groupBy("source_dataset").agg(n_rows().alias("input_rows"), F.count_if(F.col("fp").isNull()).alias("empty_rows"))
    out = counts.join(written, "source_dataset", "left")
    return out.select("source_dataset", "input_rows", F.coalesce("written", F.lit(0)).alias("written_rows"), (F.col("input_rows") - F.col("empty_rows") - F.coalesce("written", F.lit(0))).alias("duplicate_rows"), "empty_rows")


def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post for every (canonical forum, prefix fingerprint): highest priority of its layer, then smallest key."""
    forums = broadcast_if_small(table(spark, sf_dir, "forums").select("forum_id", "source_layer"))
    rows = _posts(spark, sf_dir).filter(F.length(F.trim("text")) > 0).join(forums, "forum_id", "left")
    rows = rows.select("post_key", F.regexp_replace("forum_id", "[0-9]+$", "").alias("canonical_forum"), X.prefix_fingerprint(F.col("text")).alias("fp"), F.when(F.col("source_layer") == "exploit_archive", 3).when(F.col("source_layer") == "advisory_reference", 2).otherwise(1).alias("priority"))
    return keep_priority(rows, ["canonical_forum", "fp"], "priority", "post_key").select("canonical_forum", "fp", "post_key", "priority", "removed")


def dedup_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First item of every (identifier, text) pair."""
    rows = table(spark, sf_dir, "task1_cve_linkage").select("item_id", "cve_id", X.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    return keep_first(rows, ["cve_id", "fp"], "item_id")


def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a timestamp, an identifier, keywords, short and long texts, mostly ASCII and Cyrillic, in one pass."""
    t = F.coalesce("text", F.lit(""))
    n = F.size(X.tokens(t))
    return _posts(spark, sf_dir).agg(
        n_rows().alias("n_rows"), F.count("timestamp").alias("with_timestamp"), F.count_if(t.rlike(r"CVE-\d{4}-\d{4,7}")).alias("with_cve"), F.count_if(n < 8).alias("short_rows"), F.count_if(n > 3000).alias("long_rows"),
        F.count_if(X.ascii_ratio(t) >= 0.9).alias("ascii_rows"), F.count_if(t.rlike("[\\u0400-\\u04FF]")).alias("cyrillic_rows"), F.count_if(X.cti_score(t) > 0).alias("cti_rows"),
    )


def layer_forum_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer, forum and both with the share of all rows: one scan, pre-aggregated to forums before the sets expand."""
    by_forum = _posts(spark, sf_dir).groupBy("forum_id").agg(n_rows().alias("n"))
    named = by_forum.join(broadcast_if_small(table(spark, sf_dir, "forums").select("forum_id", "source_layer")), "forum_id", "left")
    out = named.groupingSets([["source_layer"], ["forum_id"], ["source_layer", "forum_id"], []], "source_layer", "forum_id").agg(F.sum("n").alias("n"), F.grouping_id("source_layer", "forum_id").cast("int").alias("level"))
    whole = out.filter("level = 3").select(F.col("n").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select("source_layer", "forum_id", "level", "n", F.round(100.0 * F.col("n") / F.col("_all"), 3).alias("pct"))


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by number of tokens in six classes."""
    n = F.size(X.tokens(F.coalesce("text", F.lit(""))))
    bucket = F.when(n < 8, "0-7").when(n < 32, "8-31").when(n < 128, "32-127").when(n < 512, "128-511").when(n <= 3000, "512-3000").otherwise(">3000")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(n_rows().alias("n"))


def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by year of their ISO timestamps."""
    return _posts(spark, sf_dir).select(F.year(X.iso_date(F.col("timestamp"))).alias("year")).filter("year is not null").groupBy("year").agg(n_rows().alias("n"))


def upper_median_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the number of words by source, from the histogram of counts: no source's rows are sorted."""
    counts = table(spark, sf_dir, "documents").select("source", X.word_count(F.coalesce("text", F.lit(""))).alias("words")).groupBy("source", "words").agg(n_rows().alias("n"))
    w = W.partitionBy("source")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("words"))).withColumn("total", F.sum("n").over(w))
    return run.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("source").agg(F.min("words").alias("median_words"), F.max("total").alias("n_docs"))


def source_stats_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, dates and mean tokens of every source beside the links of every source, sources of either kind kept."""
    docs = table(spark, sf_dir, "documents")
    day = F.date_format("published_at", "yyyy-MM-dd")
    stats = docs.groupBy("source").agg(n_rows().alias("docs"), F.min(F.when(day > "1990", day)).alias("first_day"), F.max(F.when(day > "1990", day)).alias("last_day"), F.round(F.avg(F.greatest(F.lit(1), F.floor(F.length("text") / 4))), 6).alias("mean_tokens"))
    items = table(spark, sf_dir, "task1_cve_linkage").groupBy("source").agg(n_rows().alias("links"), F.count_distinct("id").alias("linked_posts"), F.count_distinct("cve_id").alias("cves"))
    return stats.join(items, "source", "full").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "links", "linked_posts", "cves")], "first_day", "last_day", "mean_tokens")


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by layer and source with subtotals."""
    counts = table(spark, sf_dir, "documents").groupBy("source_layer", "source").agg(n_rows().alias("n"), F.sum("n_chars").alias("chars"))
    return counts.rollup("source_layer", "source").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


def raw_corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids, threads and forums, repeated ids and texts, and coverage rates of the crawl."""
    raw = table(spark, sf_dir, "raw_posts").select("id", "thread_id", "forum_id", "cve_refs", "timestamp", "scraped_at", "author_hash", F.trim(F.coalesce("body", F.lit(""))).alias("b"))
    real = F.coalesce("timestamp", F.lit("")) != F.coalesce("scraped_at", F.lit(""))
    texts = raw.filter("b <> ''").groupBy(F.sha2("b", 256).alias("fp")).agg((n_rows() - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("exact_duplicates"))
    ids = raw.groupBy("id").agg((n_rows() - 1).alias("extra")).agg(F.sum("extra").alias("repeated_ids"))
    threads = raw.select("forum_id", "thread_id").distinct().agg(F.count("thread_id").alias("threads"))
    rates = raw.agg(n_rows().alias("n_rows"), F.count_distinct("forum_id").alias("forums"), F.count_if(real).alias("real_timestamps"), F.count_if(F.size("cve_refs") > 0).alias("with_cve"), F.round(100.0 * F.count("author_hash") / n_rows(), 2).alias("author_pct"))
    return rates.crossJoin(F.broadcast(texts)).crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(threads))


def quality_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, labels, short and non-ASCII texts and repeated texts of every split."""
    rows = table(spark, sf_dir, "task2_exploit_type").select(F.col("_split").alias("split"), "label", F.coalesce("text", F.lit("")).alias("t"))
    other = F.length(F.col("t")) - F.length(F.regexp_replace("t", r"[^\x00-\x7F]", ""))
    main = rows.groupBy("split").agg(n_rows().alias("n_rows"), F.count_distinct("label").alias("labels"), F.count_if(X.word_count(F.col("t")) < 8).alias("short_rows"), F.count_if(other > 10).alias("non_ascii_rows"))
    dup = rows.groupBy("split", X.fingerprint(F.col("t")).alias("fp")).agg((n_rows() - 1).alias("extra")).groupBy("split").agg(F.sum("extra").alias("duplicate_rows"))
    return main.join(dup, "split")


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest sources, ties by name."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(n_rows().alias("n")).orderBy(F.desc("n"), "source").limit(25)


def source_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, one entry for every year that the data hold, in order, as ``year=log10(n + 1)``.

    A map in place of columns, so that the result's form does not depend on the years; undated documents stand under 0.
    """
    n = table(spark, sf_dir, "documents").groupBy("source", F.coalesce(F.year("published_at"), F.lit(0)).alias("y")).agg(n_rows().alias("n"))
    every = n.select("y").distinct()
    cells = n.select("source").distinct().crossJoin(F.broadcast(every)).join(n, ["source", "y"], "left")
    one = F.concat(F.col("y").cast("string"), F.lit("="), F.format_string("%.6f", F.log10(F.coalesce("n", F.lit(0)) + 1.0)))
    return cells.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(one)), " ").alias("log_counts"))


def layer_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every source spread evenly over its years and summed by layer and year."""
    spread = uniform_year_spread(spark, sf_dir)
    layers = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("source_layer").alias("source_layer"))
    return spread.join(layers, "source").groupBy("source_layer", "year").agg(F.sum("share").alias("n"))


def source_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by layer and every year that the data hold, undated ones under a null year, with log10(n + 1)."""
    docs = table(spark, sf_dir, "documents").groupBy("source_layer", F.year("published_at").alias("year")).agg(n_rows().alias("n"))
    return docs.select("source_layer", "year", "n", F.round(F.log10(F.col("n") + 1.0), 6).alias("log_n"))


def uniform_year_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every source spread evenly over its years, the remainder to the earliest."""
    spans = table(spark, sf_dir, "documents").groupBy("source").agg(n_rows().alias("n"), F.year(F.min("published_at")).alias("y0"), F.year(F.max("published_at")).alias("y1")).filter("y0 is not null")
    k = F.col("y1") - F.col("y0") + 1
    return spans.select("source", "n", "y0", k.alias("k"), F.explode(F.sequence("y0", "y1")).alias("year")).select("source", "year", (F.expr("n div k") + F.when(F.col("year") - F.col("y0") < F.col("n") % F.col("k"), 1).otherwise(0)).alias("share"))


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the linkage items: unique ids, missing golds, repeated texts, range of dates, labels outside the classes."""
    items, pairs = table(spark, sf_dir, "task1_cve_linkage"), table(spark, sf_dir, "ev_pairs")
    gold = items.select("cve_id").join(pairs.select("cve_id").filter("cve_id is not null").distinct(), "cve_id", "left_anti").agg(n_rows().alias("gold_missing"))
    main = items.agg(n_rows().alias("n_rows"), F.count_distinct("item_id").alias("unique_items"), (n_rows() - F.count_distinct(X.fingerprint(F.coalesce("text", F.lit(""))))).alias("repeated_texts"), F.min(F.substring("timestamp", 1, 10)).alias("first_day"), F.max(F.substring("timestamp", 1, 10)).alias("last_day"))
    outside = table(spark, sf_dir, "task2_exploit_type").agg(F.count_if(~F.col("label").isin("rce", "memory_corruption", "injection", "xss", "dos", "file_inclusion", "auth_access", "info_disclosure")).alias("labels_outside"))
    return main.crossJoin(F.broadcast(gold)).crossJoin(F.broadcast(outside))


def tpch_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way inner join with a fixed dimension: revenue by nation and year of the orders of one segment."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    exact = (F.round(F.col("l_extendedprice") * 100) * (100 - F.round(F.col("l_discount") * 100))).cast(BIG)  # in ten-thousandths: sums of integers do not depend on their order
    per_order = li.groupBy("l_orderkey").agg(F.sum(exact).alias("v"))
    out = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "year").agg(F.sum("v").alias("revenue_e4"), n_rows().alias("orders"))


QUERIES = {f.__name__: f for f in (exact_dedup_keep_first, dedup_source_stats, dedup_priority, dedup_composite_key, corpus_counters, layer_forum_grouping_sets, token_histogram, year_histogram, upper_median_tokens, source_stats_full_outer, category_rollup, raw_corpus_audit, quality_by_split, top_sources, source_year_pivot, layer_year_pivot, source_year_counts, uniform_year_spread, integrity_report, tpch_priority_join)}

NORMAL = r"trim(regexp_replace(lower({}), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_n = lambda c: NORMAL.format(c)
_tok = lambda c: f"len(regexp_extract_all({c}, '[A-Za-z0-9_./:-]+'))"
_cti = " + ".join(f"(case when contains(lower(t), '{k}') then {w} else 0 end)" for w, ks in X.CTI_KEYWORDS for k in ks)
SQL = {
    "exact_dedup_keep_first": f"with r as (select post_key, {_n('text')} n from forum_posts) select sha256(n) as fp, min(post_key) as post_key, count(*) as n_rows from r where n <> '' group by 1",
    "dedup_source_stats": f"""with r as (select post_key, source_dataset, nullif({_n("coalesce(text, '')")}, '') as n from forum_posts),
f as (select n, arg_min(source_dataset, post_key) as source_dataset from r where n is not null group by n),
w as (select source_dataset, count(*) as written from f group by 1), c as (select source_dataset, count(*) as input_rows, count(*) filter (n is null) as empty_rows from r group by 1)
select c.source_dataset, input_rows, coalesce(written, 0) as written_rows, input_rows - empty_rows - coalesce(written, 0) as duplicate_rows, empty_rows from c left join w on c.source_dataset = w.source_dataset""",
    "dedup_priority": f"""with r as (select post_key, regexp_replace(p.forum_id, '[0-9]+$', '') as canonical_forum, md5({_n('substr(text, 1, 400)')}) as fp,
case source_layer when 'exploit_archive' then 3 when 'advisory_reference' then 2 else 1 end as priority from forum_posts p left join forums f on p.forum_id = f.forum_id where length(trim(text, ' ')) > 0),
k as (select *, row_number() over (partition by canonical_forum, fp order by priority desc, post_key) as rn, count(*) over (partition by canonical_forum, fp) - 1 as removed from r)
select canonical_forum, fp, post_key, priority, removed from k where rn = 1""",
    "dedup_composite_key": f"select cve_id, sha256({_n("coalesce(text, '')")}) as fp, min(item_id) as item_id from task1_cve_linkage group by 1, 2",
    "corpus_counters": f"""with r as (select *, coalesce(text, '') as t from forum_posts) select count(*) as n_rows, count(timestamp) as with_timestamp, count(*) filter (regexp_matches(t, 'CVE-\\d{{4}}-\\d{{4,7}}')) as with_cve,
count(*) filter ({_tok('t')} < 8) as short_rows, count(*) filter ({_tok('t')} > 3000) as long_rows, count(*) filter (case when t = '' then 0 else length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))::double / length(t) end >= 0.9) as ascii_rows,
count(*) filter (regexp_matches(t, '[\\x{{0400}}-\\x{{04FF}}]')) as cyrillic_rows, count(*) filter (({_cti}) > 0) as cti_rows from r""",
    "layer_forum_grouping_sets": """with g as (select source_layer, p.forum_id, grouping(source_layer, p.forum_id)::int as level, count(*) as n from forum_posts p left join forums f on p.forum_id = f.forum_id
group by grouping sets ((source_layer), (p.forum_id), (source_layer, p.forum_id), ())) select source_layer, forum_id, level, n, round(100.0::double * n / (select count(*) from forum_posts), 3) as pct from g""",
    "token_histogram": f"with r as (select {_tok("coalesce(text, '')")} as n from documents) select case when n < 8 then '0-7' when n < 32 then '8-31' when n < 128 then '32-127' when n < 512 then '128-511' when n <= 3000 then '512-3000' else '>3000' end as bucket, count(*) as n from r group by 1",
    "year_histogram": r"select year(try_cast(substr(timestamp, 1, 10) as date))::int as year, count(*) as n from forum_posts where regexp_matches(substr(timestamp, 1, 10), '^\d{4}-\d{2}-\d{2}$') and try_cast(substr(timestamp, 1, 10) as date) is not null group by 1",
    "upper_median_tokens": r"with r as (select source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+'))::int as words from documents), k as (select *, row_number() over (partition by source order by words) - 1 as i, count(*) over (partition by source) as n from r) select source, words as median_words, n as n_docs from k where i = n // 2",
    "source_stats_full_outer": """with d as (select source, count(*) as docs, min(case when strftime(published_at, '%Y-%m-%d') > '1990' then strftime(published_at, '%Y-%m-%d') end) as first_day, max(case when strftime(published_at, '%Y-%m-%d') > '1990' then strftime(published_at, '%Y-%m-%d') end) as last_day,
round(avg(greatest(1, length(text) // 4)) filter (text is not null or text is null), 6) as mean_tokens from documents group by 1), i as (select source, count(*) as links, count(distinct id) as linked_posts, count(distinct cve_id) as cves from task1_cve_linkage group by 1)
select coalesce(d.source, i.source) as source, coalesce(docs, 0) as docs, coalesce(links, 0) as links, coalesce(linked_posts, 0) as linked_posts, coalesce(cves, 0) as cves, first_day, last_day, mean_tokens from d full join i on d.source = i.source""",
    "category_rollup": "select source_layer, source, count(*) as n, sum(n_chars)::bigint as chars, grouping(source_layer, source)::int as level from documents group by rollup (source_layer, source)",
    "raw_corpus_audit": """with r as (select *, trim(coalesce(body, ''), ' ') as b from raw_posts) select count(*) as n_rows, count(distinct forum_id) as forums, count(*) filter (coalesce(timestamp, '') <> coalesce(scraped_at, '')) as real_timestamps, count(*) filter (len(cve_refs) > 0) as with_cve, round(100.0::double * count(author_hash) / count(*), 2) as author_pct,
(select coalesce(sum(k), 0)::bigint from (select count(*) - 1 as k from r where b <> '' group by b)) as exact_duplicates, (select sum(k)::bigint from (select count(*) - 1 as k from r group by id)) as repeated_ids, (select count(*) from (select distinct forum_id, thread_id from r) where thread_id is not null) as threads from r""",
    "quality_by_split": rf"""with r as (select _split as split, label, coalesce(text, '') as t from task2_exploit_type), d as (select split, sum(k)::bigint as duplicate_rows from (select split, count(*) - 1 as k from r group by split, {_n('t')}) group by 1)
select r.split, count(*) as n_rows, count(distinct label) as labels, count(*) filter (len(regexp_extract_all(t, '[^ \t\n\r\f\v]+')) < 8) as short_rows, count(*) filter (length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) > 10) as non_ascii_rows, any_value(duplicate_rows) as duplicate_rows from r join d on r.split = d.split group by 1""",
    "top_sources": "select source, count(*) as n from documents group by 1 order by n desc, source limit 25",
    "source_year_pivot": "with n as (select source, coalesce(year(published_at), 0) as y, count(*) as n from documents group by 1, 2), c as (select s.source, e.y, coalesce(n.n, 0) as n from (select distinct source from n) s cross join (select distinct y from n) e left join n on n.source = s.source and n.y = e.y) select source, string_agg(y::varchar || '=' || printf('%.6f', log10(n + 1.0::double)), ' ' order by y::varchar) as log_counts from c group by 1",
    "layer_year_pivot": "with s as (select source, min(source_layer) as source_layer, count(*) as n, year(min(published_at)) as y0, year(max(published_at)) as y1 from documents group by 1) select source_layer, year::int as year, sum(n // (y1 - y0 + 1) + case when year - y0 < n % (y1 - y0 + 1) then 1 else 0 end)::bigint as n from s, unnest(range(y0, y1 + 1)) as u(year) where y0 is not null group by 1, 2",
    "source_year_counts": "select source_layer, year(published_at)::int as year, count(*) as n, round(log10(count(*) + 1.0::double), 6) as log_n from documents group by 1, 2",
    "uniform_year_spread": "with s as (select source, count(*) as n, year(min(published_at)) as y0, year(max(published_at)) as y1 from documents group by 1) select source, year::int as year, n // (y1 - y0 + 1) + case when year - y0 < n % (y1 - y0 + 1) then 1 else 0 end as share from s, unnest(range(y0, y1 + 1)) as u(year) where y0 is not null",
    "integrity_report": f"""select count(*) as n_rows, count(distinct item_id) as unique_items, count(*) - count(distinct {_n("coalesce(text, '')")}) as repeated_texts, min(substr(timestamp, 1, 10)) as first_day, max(substr(timestamp, 1, 10)) as last_day,
(select count(*) from task1_cve_linkage i where cve_id is not null and not exists (select 1 from ev_pairs p where p.cve_id = i.cve_id)) + (select count(*) from task1_cve_linkage where cve_id is null) as gold_missing,
(select count(*) from task2_exploit_type where label not in ('rce', 'memory_corruption', 'injection', 'xss', 'dos', 'file_inclusion', 'auth_access', 'info_disclosure')) as labels_outside from task1_cve_linkage""",
    "tpch_priority_join": "with v as (select l_orderkey, sum((round(l_extendedprice * 100) * (100 - round(l_discount * 100)))::bigint) as v from lineitem group by 1) select n_name, year(o_orderdate)::int as year, sum(v)::bigint as revenue_e4, count(*) as orders from v join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
}
