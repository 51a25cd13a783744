"""Joins, splits, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions.common import filled, n_rows
from ctilake.functions import text as X
from ctilake.operators.sampling import balanced, per_stratum, round_robin
from ctilake.sources.tables import broadcast_if_small, cut, table



def _family(cve):
    """Year and one of twenty classes of an identifier. The test tables share no identifier, so joins between them go by this."""
    return F.concat(F.substring(cve, 1, 9), (F.substring(cve, 10, 20).try_cast("bigint") % 20).cast("string"))


def linkage_split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose gold exists, with a split by date, by the identifier's year where there is no date, else test."""
    golds = table(spark, sf_dir, "ev_pairs").select(_family("cve_id").alias("family")).distinct()
    items = table(spark, sf_dir, "task1_cve_linkage").withColumn("family", _family("cve_id")).join(golds, "family", "left_semi")
    year = X.cve_year(F.col("cve_id"))
    by_year = F.when(year < 2022, "train").when(year < 2024, "val").otherwise("test")
    return items.select("item_id", "cve_id", F.coalesce(X.date_split(X.iso_date(F.col("timestamp"))), by_year).alias("new_split"))


def cve_year_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items after those leave whose identifier the training items have, by split and year."""
    items = table(spark, sf_dir, "task1_cve_linkage").select("item_id", "cve_id", "split")
    seen = items.filter("split = 'train'").select("cve_id").distinct()
    return items.filter("split <> 'train'").join(seen, "cve_id", "left_anti").groupBy("split", X.cve_year(F.col("cve_id")).alias("year")).agg(n_rows().alias("n"))


def ev_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pairs: documents by each identifier they mention, joined with the vulnerability texts of it."""
    mentions = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform("cve_refs", _family))).alias("family"))
    known = table(spark, sf_dir, "ev_pairs").filter("cve_id is not null and vulnerability_text is not null").groupBy(_family("cve_id").alias("family")).agg(F.min("pair_id").alias("pair_id"))
    links = table(spark, sf_dir, "task1_cve_linkage").groupBy(_family("cve_id").alias("family")).agg(F.min("item_id").alias("item_id"))
    return mentions.join(links, "family", "left").join(known, "family", "left").groupBy(F.col("pair_id").isNotNull().alias("has_pair"), F.col("item_id").isNotNull().alias("has_item")).agg(n_rows().alias("n"), F.count_distinct("doc_id").alias("docs"))


def negative_for_every_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One negative for every pair with an identifier: the next pair of another identifier in hash order, the first after the last.

    Pairs are ordered within 4,096 hash buckets, so no task holds more than its share. Pairs without
    another identifier in the rest of their bucket all have the bucket's last one, and get theirs from
    a summary of the buckets. Where all pairs have one identifier there are no negatives.
    """
    key = F.md5(F.concat(F.lit("42|"), F.col("pair_id").cast("string")))
    rows = table(spark, sf_dir, "ev_pairs").filter("cve_id is not null").select("pair_id", "cve_id", key.alias("k")).withColumn("bucket", F.conv(F.substring("k", 1, 3), 16, 10).cast("int"))
    w = W.partitionBy("bucket").orderBy(F.desc("k"), F.desc("pair_id"))
    # from the end: the last row of every run of equal identifiers names the first of the next run
    rows = rows.withColumn("next", F.when(F.lag("cve_id").over(w) != F.col("cve_id"), F.struct(F.lag("pair_id").over(w).alias("pair_id"))))
    rows = rows.withColumn("next", F.last("next", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = F.struct("k", "pair_id")
    ends = rows.groupBy("bucket").agg(F.min_by("pair_id", at).alias("first"), F.min_by("cve_id", at).alias("first_cve"), F.min_by(F.col("next.pair_id"), at).alias("second"), F.max_by("cve_id", at).alias("last_cve")).orderBy("bucket").collect()
    over = []
    for i, end in enumerate(ends):
        for b in ends[i + 1 :] + ends[: i + 1]:
            other = b["first"] if b["first_cve"] != end["last_cve"] else b["second"]
            if other is not None:
                over.append((end["bucket"], other))
                break
    over = F.broadcast(spark.createDataFrame(over, "bucket int, over bigint"))
    return rows.join(over, "bucket", "left").select("pair_id", F.coalesce("next.pair_id", "over").alias("negative_id")).filter("negative_id is not null")


def balanced_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many posts with an identifier as without in every source, chosen in hash order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.size("cve_refs") > 0).cast("int").alias("label"))
    return balanced(rows, ["source"], "label", "doc_id")


def label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 records of every label in every split, in hash order: the cap is the feature."""
    rows = table(spark, sf_dir, "task2_exploit_type").select("rec_id", F.col("_split").alias("split"), "label")
    return per_stratum(rows, ["split", "label"], "rec_id", 40).select("rec_id", "split", "label")


def round_robin_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 records drawn in turn from every (split, label), in hash order."""
    rows = table(spark, sf_dir, "task2_exploit_type").select("rec_id", F.concat_ws("/", "_split", "label").alias("stratum"))
    return round_robin(rows, "stratum", "rec_id", 60)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent of the rows of every source by a threshold on the hash of the key: the sample is the feature."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(draw < int(0.05 * 2**32)).alias("sampled"), n_rows().alias("n"))


def time_spell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by one of twelve equal spans of time, with the quota of 1000 rows that each span gets."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("d"))
    bounds = orders.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spell = F.least(F.greatest(F.floor((F.col("d") - F.col("lo")) * 12 / (F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(11)).cast("int")
    n = orders.crossJoin(F.broadcast(bounds)).filter("hi > lo").groupBy(spell.alias("spell")).agg(n_rows().alias("n"))
    return n.select("spell", "n", F.greatest(F.lit(1), F.bround(1000.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).cast("int")).alias("quota"))


def split_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two splits share, for every pair of splits: splits are gathered by text first, so pairs come from a handful of names."""
    rows = table(spark, sf_dir, "task2_exploit_type").select(F.col("_split").alias("s"), X.normal(filled()).alias("n")).filter("n <> ''").select("s", F.sha2("n", 256).alias("fp"))
    by = rows.groupBy("fp").agg(F.array_sort(F.collect_set("s")).alias("s"))
    pairs = by.filter(F.size("s") > 1).select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("left_split"), F.col("p.b").alias("right_split")).agg(n_rows().alias("shared"))


def vocab_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the vocabularies of every two document layers; words occur in three rows at least."""
    words = table(spark, sf_dir, "documents").select("source_layer", F.explode(F.array_distinct(X.vocabulary_tokens(filled()))).alias("w"))
    kept = cut(words.groupBy("source_layer", "w").agg(n_rows().alias("n")).filter("n >= 3"))
    sizes = kept.groupBy("source_layer").agg(n_rows().alias("size"))
    by = kept.groupBy("w").agg(F.array_sort(F.collect_set("source_layer")).alias("s"))
    pairs = by.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(n_rows().alias("shared"))
    left, right = sizes.select(F.col("source_layer").alias("a"), F.col("size").alias("na")), sizes.select(F.col("source_layer").alias("b"), F.col("size").alias("nb"))
    return both.join(broadcast_if_small(left), "a").join(broadcast_if_small(right), "b").select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def corpus_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of items and of pairs: on either side alone or on both."""
    a = table(spark, sf_dir, "task1_cve_linkage").select(_family("cve_id").alias("family")).filter("family is not null").distinct().withColumn("in_items", F.lit(True))
    b = table(spark, sf_dir, "ev_pairs").select(_family("cve_id").alias("family")).filter("family is not null").distinct().withColumn("in_pairs", F.lit(True))
    return a.join(b, "family", "full").groupBy(F.coalesce("in_items", F.lit(False)).alias("in_items"), F.coalesce("in_pairs", F.lit(False)).alias("in_pairs")).agg(n_rows().alias("n"))


def latest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every thread by its last row, and the number of its posts; ``posts_with_title`` joins it back to them."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_id is not null")
    return raw.groupBy("forum_id", "thread_id").agg(F.max_by("thread_title", "row_id").alias("title"), n_rows().alias("posts"))


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events with the largest value of every type, ties by id."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return e.withColumn("place", F.row_number().over(w)).filter("place <= 20").select("event_type", "event_id", "value", "place")


def posts_with_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post of a thread with the title that the thread had last."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_id is not null").select("row_id", "forum_id", "thread_id")
    return raw.join(latest_title(spark, sf_dir).drop("posts"), ["forum_id", "thread_id"], "left").select("row_id", "title")


def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One negative for every pair with an identifier, see ``negative_for_every_pair``."""
    return negative_for_every_pair(spark, sf_dir)


QUERIES = {f.__name__: f for f in (linkage_split_semi, cve_year_disjoint, ev_pairs, negative_pairs, negative_for_every_pair, balanced_pos_neg, label_cap, round_robin_strata, hash_sample, time_spell_sample, split_overlap_matrix, vocab_jaccard, corpus_difference, latest_title, posts_with_title)}
QUERIES["top_events_by_type"] = exact_search
_norm = lambda c: rf"trim(regexp_replace(lower({c}), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_ISO = r"regexp_matches(substr(timestamp, 1, 10), '^\d{4}-\d{2}-\d{2}$')"
_DAY = f"(case when {_ISO} then try_cast(substr(timestamp, 1, 10) as date) end)"
_YEAR = r"try_cast(nullif(regexp_extract(cve_id, '^CVE-(\d{4})-', 1), '') as int)"
_rank = lambda part, key: f"row_number() over (partition by {part} order by md5('42|' || {key}::varchar), {key})"
_fam = lambda c: f"(substr({c}, 1, 9) || (try_cast(substr({c}, 10) as bigint) % 20)::varchar)"
SQL = {
    "linkage_split_semi": f"""select item_id, cve_id, case when {_DAY} < '2022-01-01' then 'train' when {_DAY} < '2024-01-01' then 'val' when {_DAY} is not null then 'test' when {_YEAR} < 2022 then 'train' when {_YEAR} < 2024 then 'val' else 'test' end as new_split
from task1_cve_linkage i where exists (select 1 from ev_pairs p where {_fam('p.cve_id')} = {_fam('i.cve_id')})""",
    "cve_year_disjoint": f"select split, {_YEAR} as year, count(*) as n from task1_cve_linkage i where split <> 'train' and not exists (select 1 from task1_cve_linkage t where t.split = 'train' and t.cve_id = i.cve_id) group by 1, 2",
    "ev_pairs": f"""with r as (select doc_id, unnest(cve_refs) as c from documents), m as (select distinct doc_id, {_fam('c')} as f from r) select pair_id is not null as has_pair, item_id is not null as has_item, count(*) as n, count(distinct doc_id) as docs from m
left join (select {_fam('cve_id')} as f, min(item_id) as item_id from task1_cve_linkage group by 1) i on m.f = i.f left join (select {_fam('cve_id')} as f, min(pair_id) as pair_id from ev_pairs where cve_id is not null and vulnerability_text is not null group by 1) p on m.f = p.f group by 1, 2""",
    "negative_for_every_pair": """with r as (select pair_id, cve_id, row_number() over (order by md5('42|' || pair_id::varchar), pair_id) as i, count(*) over () as n from ev_pairs where cve_id is not null), t as (select *, i as j from r union all select *, i + n from r),
l as (select *, lead(pair_id) over w as o, lead(cve_id) over w as c from t window w as (order by j)), m as (select pair_id, i = j as own, first_value(case when c <> cve_id then o end ignore nulls) over (order by j rows between current row and unbounded following) as negative_id from l)
select pair_id, negative_id from m where own and negative_id is not null""",
    "balanced_pos_neg": f"""with r as (select doc_id, source, (len(cve_refs) > 0)::int as label from documents), k as (select *, {_rank('source, label', 'doc_id')} as rn, least(count(*) filter (label = 1) over (partition by source), count(*) filter (label = 0) over (partition by source)) as m from r)
select doc_id, source, label from k where rn <= m""",
    "label_cap": f"with k as (select rec_id, _split as split, label, {_rank('_split, label', 'rec_id')} as rn from task2_exploit_type) select rec_id, split, label from k where rn <= 40",
    "round_robin_strata": f"""with r as (select rec_id, concat_ws('/', _split, label) as stratum from task2_exploit_type), k as (select *, {_rank('stratum', 'rec_id')}::int as turn from r) select rec_id, stratum, turn from k order by turn, stratum limit 60""",
    "hash_sample": f"select source, count(*) filter (('0x' || substr(md5('42|' || doc_id::varchar), 1, 8))::bigint < {int(0.05 * 2**32)}) as sampled, count(*) as n from documents group by 1",
    "time_spell_sample": """with r as (select date_diff('day', date '1970-01-01', o_orderdate::date) as d from orders), b as (select min(d) as lo, max(d) as hi from r), s as (select least(greatest(floor((d - lo) * 12.0::double / (hi - lo)), 0), 11)::int as spell, count(*) as n from r, b group by 1)
select spell, n, greatest(1, round_even(1000.0::double * n / sum(n) over (), 0))::int as quota from s""",
    "split_overlap_matrix": f"""with r as (select distinct _split as s, {_norm("coalesce(text, '')")} as n from task2_exploit_type) select a.s as left_split, b.s as right_split, count(*) as shared from r a join r b on a.n = b.n and a.s < b.s where a.n <> '' group by 1, 2""",
    "vocab_jaccard": r"""with w as (select distinct doc_id, source_layer, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\-]{3,}')) as w from documents), k as (select source_layer, w from w group by 1, 2 having count(*) >= 3), s as (select source_layer, count(*) as n from k group by 1),
p as (select a.source_layer as a, b.source_layer as b, count(*) as shared from k a join k b on a.w = b.w and a.source_layer < b.source_layer group by 1, 2) select a, b, shared, round(shared::double / (x.n + y.n - shared), 6) as jaccard from p join s x on a = x.source_layer join s y on b = y.source_layer""",
    "corpus_difference": f"with a as (select distinct {_fam('cve_id')} as f from task1_cve_linkage where cve_id is not null), b as (select distinct {_fam('cve_id')} as f from ev_pairs where cve_id is not null) select a.f is not null as in_items, b.f is not null as in_pairs, count(*) as n from a full join b on a.f = b.f group by 1, 2",
    "posts_with_title": "select row_id, first_value(thread_title) over (partition by forum_id, thread_id order by row_id desc) as title from raw_posts where thread_id is not null",
    "latest_title": "select forum_id, thread_id, (array_agg(thread_title order by row_id desc))[1] as title, count(*) as posts from raw_posts where thread_id is not null group by 1, 2",
    "top_events_by_type": "with k as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id)::int as place from events) select * from k where place <= 20",
}
SQL["negative_pairs"] = SQL["negative_for_every_pair"]
