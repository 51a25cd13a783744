"""The preprocessing pipeline, corpus profiles, estimates, selections and samples as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions import text as X
from ctilake.functions.common import filled, n_rows
from ctilake.operators import neardup as D
from ctilake.operators import pipeline as P
from ctilake.operators.sampling import hash_order, per_stratum
from ctilake.sources.tables import broadcast_if_small, cut, table

BLOCKED_FORUMS = ("brinbase", "ombhive")
SAMPLE = 200
# Priorities of sources in the order in which names are tried, and other names of a forum.
PRIORITIES = [("exploit_archive", 5), ("advisory_db", 4), ("nvdlike", 4), ("bounty_reports", 3), ("fix_commits", 2), ("packet", 2)]
PROFILES = [("board", 3), ("hive", 1), ("den", 4), ("norhive", 5)]
ALIASES = {"norloft1": "norhive", "velmhive1": "velmhive", "tarkhive1": "tarkhive"}


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidates(table(spark, sf_dir, "raw_posts"), "row_id", cleaner=X.strip_html, blocked=BLOCKED_FORUMS)


def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that every stage of the pipeline drops, and those kept."""
    return _candidates(spark, sf_dir).groupBy(F.coalesce("failed", F.lit("kept")).alias("stage")).agg(n_rows().alias("n"), F.sum("score").alias("score"))


def pipeline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's posts: kept rows, first of every text, 200 of them over twelve spans of time by score."""
    kept = cut(P.first_of_texts(_candidates(spark, sf_dir)))
    return P.temporal_sample(kept, SAMPLE, 12).withColumnRenamed("key", "row_id")


def pipeline_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept posts that the near-duplicate filter leaves: the highest scores first, a post goes when one that stays is similar to it."""
    rows = cut(_candidates(spark, sf_dir))
    first = P.first_of_texts(rows)
    texts = cut(first.join(rows.select("key", "text"), "key").select("key", "score", "text"))
    kept = D.greedy_kept(texts.select("key", "score"), D.minhash_edges(texts, "key", "text"), -F.col("score"))
    return kept.select(F.col("key").alias("row_id"), "kept")


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, and values at 5 and 95 % of the sorted row, of words by source, from the histogram of counts."""
    counts = table(spark, sf_dir, "documents").select("source", X.word_count(filled()).alias("words")).groupBy("source", "words").agg(n_rows().alias("n"))
    w = W.partitionBy("source")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("words"))).withColumn("n_docs", F.sum("n").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("words")))
    half = F.floor(F.col("n_docs") / 2)
    other = F.when(F.col("n_docs") % 2 == 0, half - 1).otherwise(half)
    return run.groupBy("source").agg(F.max("n_docs").alias("n_docs"), ((at(half) + at(other)) / 2).alias("median"), at(F.floor(F.col("n_docs") * 0.05)).alias("p5"), at(F.floor(F.col("n_docs") * 0.95)).alias("p95"))


def near_dup_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled posts, near-duplicates among them that an earlier sampled post has, and what that comes to over all posts.

    The sample takes 30 in a hundred posts by the hash of their key (the tables are small; the share
    is a parameter). Posts are visited in key order and a match is not a base for further matches.
    """
    posts = table(spark, sf_dir, "forum_posts").filter(F.trim(filled()) != "")
    sampled = cut(posts.filter(F.pmod(F.xxhash64("post_key"), F.lit(100)) < 30).select("post_key", "text"))
    member = cut(D.classes(sampled, "post_key", "text"))
    nodes = member.select(F.col("class_id").alias("key")).distinct()
    kept = D.greedy_kept(nodes, D.simhash_edges(sampled, "post_key", "text").select("a", "b"))
    n = member.agg(n_rows().alias("sampled"), F.count_if(F.col("key") != F.col("class_id")).alias("copies"))
    gone = kept.agg(F.count_if(~F.col("kept")).alias("near"))
    total = posts.agg(n_rows().alias("total"))
    dups = F.col("copies") + F.col("near")
    return total.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(gone)).select("total", "sampled", dups.alias("near_duplicates"), F.round(F.try_divide(F.col("total") * dups, F.col("sampled"))).cast("bigint").alias("estimate"))


def dedup_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before, removed and after priority deduplication by file, forums under their canonical names."""
    forums = broadcast_if_small(table(spark, sf_dir, "forums").select("forum_id", "source_layer"))
    alias = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in ALIASES.items()) + ")")
    rows = table(spark, sf_dir, "forum_posts").filter(F.length(F.trim("text")) >= 20).join(forums, "forum_id", "left")
    rows = rows.select("post_key", "source_dataset", F.coalesce(F.try_element_at(alias, F.col("forum_id")), "forum_id").alias("forum"), X.prefix_fingerprint(F.col("text")).alias("fp"), F.when(F.col("source_layer") == "exploit_archive", 3).otherwise(1).alias("p"))
    best = rows.groupBy("forum", "fp").agg(F.min_by("source_dataset", F.struct(-F.col("p"), "post_key")).alias("source_dataset"))
    after = best.groupBy("source_dataset").agg(n_rows().alias("after"))
    before = rows.groupBy("source_dataset").agg(n_rows().alias("before"))
    return before.join(after, "source_dataset", "left").select("source_dataset", "before", (F.col("before") - F.coalesce("after", F.lit(0))).alias("removed"), F.coalesce("after", F.lit(0)).alias("after"))


def source_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of every source: by its name, else by the first name that begins it or that it begins, else 1."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    out = F.lit(1)
    for name, p in reversed(PRIORITIES):
        out = F.when(F.col("source").startswith(name) | F.lit(name).startswith(F.col("source")), p).otherwise(out)
    for name, p in PRIORITIES:
        out = F.when(F.col("source") == name, p).otherwise(out)
    return names.select("source", out.alias("priority"))


def forum_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl delay of every forum: of the last profile whose term its id or name holds, else two."""
    out = F.lit(2)
    for term, delay in PROFILES:
        out = F.when(F.lower("forum_id").contains(term) | F.lower("forum_name").contains(term), delay).otherwise(out)
    return table(spark, sf_dir, "forums").select("forum_id", out.alias("delay"))


def fuzzy_stats_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document source the first run statistic whose name holds it or that it holds: two small dimensions compared by name."""
    stats = table(spark, sf_dir, "unified_stats").groupBy("source_dataset").agg(F.sum("written_rows").alias("written"))
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    hit = F.col("source").contains(F.col("source_dataset")) | F.col("source_dataset").contains(F.col("source"))
    found = sources.join(broadcast_if_small(stats), hit).groupBy("source").agg(F.min_by(F.struct("source_dataset", "written"), "source_dataset").alias("s"))
    return found.select("source", "s.source_dataset", "s.written")


def thread_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every post in its thread from 0 on, by page order, where the crawl gave none or gave one twice."""
    w = W.partitionBy("forum_id", "thread_id").orderBy(F.coalesce("post_index", F.lit(2**31 - 1)), "row_id")
    return table(spark, sf_dir, "raw_posts").filter("thread_id is not null").select("row_id", (F.row_number().over(w) - 1).alias("position"))


def selected_forums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forums of the engines on a list, ordered by their place in it, then by name."""
    place = F.array_position(F.array(*map(F.lit, ("phpbb", "discourse", "mybb"))), F.col("engine"))
    chosen = table(spark, sf_dir, "forums").withColumn("place", place).filter("place > 0")
    return chosen.select("forum_id", "engine", F.row_number().over(W.orderBy("place", "forum_id")).alias("rank"))


def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source that reach the least length of their layer."""
    least = F.when(F.col("source_layer") == "exploit_archive", 40).when(F.col("source_layer") == "advisory_reference", 30).when(F.col("source_layer") == "hacker_community", 20).otherwise(10)
    return table(spark, sf_dir, "documents").groupBy("source").agg(n_rows().alias("n"), F.count_if(F.length(F.trim(filled())) >= least).alias("kept"))


def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First post of every prefix fingerprint within its source, by source."""
    first = table(spark, sf_dir, "forum_posts").filter(F.length(F.trim("text")) > 0).groupBy("source_dataset", X.prefix_fingerprint(F.col("text")).alias("fp")).agg(F.min("post_key").alias("post_key"), n_rows().alias("n"))
    return first.select("source_dataset", "post_key", "n")


def natural_id_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of every natural id of the crawl and of every identifier of the linkage items."""
    posts = table(spark, sf_dir, "raw_posts").filter("id is not null").groupBy("id").agg(F.min("row_id").alias("key")).select(F.lit("raw_posts").alias("tbl"), "id", "key")
    golds = table(spark, sf_dir, "task1_cve_linkage").filter("cve_id is not null").groupBy(F.col("cve_id").alias("id")).agg(F.min("item_id").alias("key")).select(F.lit("task1").alias("tbl"), "id", "key")
    return posts.unionByName(golds)


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty documents of every source in key order: the sample is the feature."""
    w = W.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("place", F.row_number().over(w)).filter("place <= 50")


def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 training records without replacement, in hash order: the sample is the feature."""
    return table(spark, sf_dir, "task2_exploit_type").filter("_split = 'train'").select("rec_id", "label").orderBy(*hash_order("rec_id")).limit(150)


def balanced_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 records, as many of every label as their number allows, filled up in hash order from the rest."""
    rows = table(spark, sf_dir, "task2_exploit_type").filter("label is not null").select("rec_id", "label")
    share = 120 // max(1, rows.select("label").distinct().count())
    mine = per_stratum(rows, ["label"], "rec_id", 120)  # no label can give more
    w = W.partitionBy("label").orderBy(*hash_order("rec_id"))
    ranked = mine.withColumn("_rn", F.row_number().over(w)).withColumn("fill", (F.col("_rn") > share).cast("int"))
    return ranked.orderBy("fill", *hash_order("rec_id")).limit(120).select("rec_id", "label", "fill")


def query_corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small retrieval corpus: the pairs that the first twenty queries name, and a hundred others in hash order."""
    queries = table(spark, sf_dir, "task1_cve_linkage").orderBy("item_id").limit(20).select(X.cve_year(F.col("cve_id")).alias("y")).distinct()
    pairs = table(spark, sf_dir, "ev_pairs").select("pair_id", X.cve_year(F.col("cve_id")).alias("y"))
    gold = pairs.join(F.broadcast(queries), "y", "left_semi").select("pair_id", F.lit("gold").alias("kind"))
    others = pairs.join(F.broadcast(queries), "y", "left_anti").select("pair_id").orderBy(*hash_order("pair_id")).limit(100)
    return gold.unionByName(others.select("pair_id", F.lit("distractor").alias("kind")))


def token_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every source and those that a draw of five in a hundred by document and place takes."""
    toks = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(X.vocabulary_tokens(filled())).alias("i", "tok"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return toks.groupBy("source").agg(n_rows().alias("tokens"), F.count_if(draw < int(0.05 * 2**32)).alias("sampled"))


def entities_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum entries (id, host) of which neither the id nor the host belongs to an earlier entry that was kept."""
    host = F.regexp_replace(F.lower(F.regexp_extract("thread_url", r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")
    entries = cut(table(spark, sf_dir, "raw_posts").filter("thread_url is not null").groupBy("forum_id", host.alias("host")).agg(F.min("row_id").alias("key")))
    a, b = entries.select(F.col("key").alias("a"), "forum_id", "host"), entries.select(F.col("key").alias("b"), "forum_id", "host")
    edges = a.drop("host").join(b.drop("host"), "forum_id").select("a", "b").union(a.drop("forum_id").join(b.drop("forum_id"), "host").select("a", "b")).filter("a < b").distinct()
    kept = D.greedy_kept(entries.select("key"), edges).filter("kept").select("key")
    return entries.join(kept, "key").select("forum_id", "host", "key")


QUERIES = {f.__name__: f for f in (pipeline_stages, pipeline_sample, pipeline_near_dedup, token_profile, near_dup_estimate, dedup_file_stats, source_priorities, forum_profiles, fuzzy_stats_match, thread_positions, selected_forums, length_gate, prefix_dedup, natural_id_dedup, first_rows, subsample, balanced_with_fill, query_corpus_sample, token_sample, entities_once)}

_strip = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]{{2,}}', ' ', 'g'), ' ')"""
_iso = lambda c: rf"case when regexp_matches(substr({c}, 1, 10), '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(substr({c}, 1, 10) as date) end"
_norm = lambda c: rf"trim(regexp_replace(lower({c}), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_score = " + ".join(f"(case when contains(lower(t), '{k}') then {w} else 0 end)" for w, ks in X.CTI_KEYWORDS for k in ks)
_cand = rf"""r as (select row_id, forum_id, {_strip.format("case when trim(coalesce(body, ''), ' ') <> '' then body else coalesce(thread_title, '') end")} as t, coalesce({_iso('timestamp')}, {_iso('scraped_at')}) as d, coalesce(timestamp, '') <> coalesce(scraped_at, '') as real from raw_posts),
c as (select row_id, t, d, ({_score}) as score, case when coalesce(forum_id, '') in ('brinbase', 'ombhive') then 'forum' when t = '' then 'text' when d is null then 'timestamp' when not real then 'real_timestamp' when length(regexp_replace(t, '[^\x00-\x7F]', '', 'g'))::double / length(t) < 0.85 then 'language' when not len(regexp_extract_all(t, '[^ \t\n\r\f\v]+')) between 4 and 2000 then 'length' else 'kept' end as stage from r)"""
_md5 = lambda k: f"md5('42|' || {k}::varchar), {k}"
SQL = {
    "pipeline_stages": f"with {_cand} select stage, count(*) as n, sum(score)::bigint as score from c group by 1",
    "pipeline_sample": f"""with {_cand}, k as (select * from (select *, row_number() over (partition by {_norm('t')} order by row_id) as rn from c where stage = 'kept') where rn = 1), e as (select min(d) as lo, max(d) as hi, count(*) as n from k),
p as (select row_id, score, e.n, greatest(0, least(11, coalesce(floor((d - lo) * 12.0::double / nullif(hi - lo, 0)), 0)))::int as spell from k, e), q as (select *, count(*) over (partition by spell) as size, row_number() over (partition by spell order by score desc, row_id) as place from p)
select row_id, spell, score::int as score from q where n <= 200 or place <= greatest(1, round_even(200.0::double * size / n, 0)) order by score desc, spell, place limit 200""",
    "token_profile": r"with r as (select source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+'))::int as w from documents), k as (select source, list_sort(list(w)) as l, count(*) as n from r group by 1) select source, n as n_docs, (l[n // 2 + 1] + l[case when n % 2 = 0 then n // 2 else n // 2 + 1 end]) / 2.0::double as median, l[floor(n * 0.05::double)::int + 1] as p5, l[floor(n * 0.95::double)::int + 1] as p95 from k",
    "dedup_file_stats": f"""with r as (select post_key, source_dataset, case p.forum_id when 'norloft1' then 'norhive' when 'velmhive1' then 'velmhive' when 'tarkhive1' then 'tarkhive' else p.forum_id end as forum, md5({_norm('substr(text, 1, 400)')}) as fp, case when source_layer = 'exploit_archive' then 3 else 1 end as p from forum_posts p left join forums f on p.forum_id = f.forum_id where length(trim(text, ' ')) >= 20),
k as (select *, row_number() over (partition by forum, fp order by p desc, post_key) as rn from r) select source_dataset, count(*) as before, count(*) filter (rn > 1) as removed, count(*) filter (rn = 1) as after from k group by 1""",
    "source_priorities": "select distinct source, case source when 'exploit_archive' then 5 when 'advisory_db' then 4 when 'nvdlike' then 4 when 'bounty_reports' then 3 when 'fix_commits' then 2 when 'packet' then 2 else case " + " ".join(f"when starts_with(source, '{n}') or starts_with('{n}', source) then {p}" for n, p in PRIORITIES) + " else 1 end end as priority from documents",
    "forum_profiles": "select forum_id, case " + " ".join(f"when contains(lower(forum_id), '{t}') or contains(lower(forum_name), '{t}') then {d}" for t, d in (("norhive", 5), ("den", 4), ("hive", 1), ("board", 3))) + " else 2 end as delay from forums",
    "fuzzy_stats_match": "with s as (select source_dataset, sum(written_rows)::bigint as written from unified_stats group by 1) select source, source_dataset, written from (select d.source, s.*, row_number() over (partition by d.source order by source_dataset) as rn from (select distinct source from documents) d join s on contains(d.source, source_dataset) or contains(source_dataset, d.source)) where rn = 1",
    "thread_positions": "select row_id, (row_number() over (partition by forum_id, thread_id order by coalesce(post_index, 2147483647), row_id) - 1)::int as position from raw_posts where thread_id is not null",
    "selected_forums": "select forum_id, engine, (row_number() over (order by list_position(['phpbb', 'discourse', 'mybb'], engine), forum_id))::int as rank from forums where engine in ('phpbb', 'discourse', 'mybb')",
    "length_gate": "select source, count(*) as n, count(*) filter (length(trim(coalesce(text, ''), ' ')) >= case source_layer when 'exploit_archive' then 40 when 'advisory_reference' then 30 when 'hacker_community' then 20 else 10 end) as kept from documents group by 1",
    "prefix_dedup": f"select source_dataset, min(post_key) as post_key, count(*) as n from forum_posts where length(trim(text, ' ')) > 0 group by source_dataset, md5({_norm('substr(text, 1, 400)')})",
    "natural_id_dedup": "select 'raw_posts' as tbl, id, min(row_id) as key from raw_posts where id is not null group by id union all select 'task1', cve_id, min(item_id) from task1_cve_linkage where cve_id is not null group by cve_id",
    "first_rows": "select * from (select doc_id, source, row_number() over (partition by source order by doc_id)::int as place from documents) where place <= 50",
    "subsample": f"select rec_id, label from task2_exploit_type where _split = 'train' order by {_md5('rec_id')} limit 150",
    "balanced_with_fill": f"with k as (select rec_id, label, row_number() over (partition by label order by {_md5('rec_id')}) as rn from task2_exploit_type where label is not null), f as (select rec_id, label, (rn > 120 // (select count(distinct label) from k))::int as fill from k) select * from f order by fill, {_md5('rec_id')} limit 120",
    "query_corpus_sample": f"with q as (select distinct substr(cve_id, 5, 4) as y from (select * from task1_cve_linkage order by item_id limit 20)), p as (select pair_id, exists (select 1 from q where y = substr(cve_id, 5, 4)) as g from ev_pairs) select pair_id, 'gold' as kind from p where g union all select pair_id, 'distractor' from (select pair_id from p where not g order by {_md5('pair_id')} limit 100)",
    "token_sample": r"with d as (select doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\-]{3,}') as l from documents), t as (select doc_id, source, unnest(range(len(l))) as i from d) select source, count(*) as tokens, count(*) filter (('0x' || substr(md5(doc_id::varchar || '|' || i::varchar), 1, 8))::bigint < 214748364) as sampled from t group by 1",
}
