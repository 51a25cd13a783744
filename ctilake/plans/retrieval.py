"""Retrieval and evaluation queries. Searches ask with every item or, where their SQL has it so, with the items whose id is divisible by 20, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.functions.common import n_rows
from ctilake.functions import text as X
from ctilake.operators import metrics as M
from ctilake.operators import retrieval as R
from ctilake.sources.tables import table



TWENTIETH = "item_id % 20 = 0"  # the items that searches ask with which don't take every item


def _items(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    items = table(spark, sf_dir, "task1_cve_linkage")
    return items if every else items.filter(TWENTIETH)


def _texts(spark: SparkSession, sf_dir: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries and documents (key, text, label); the label is the year of the identifier, by which gold is told."""
    year = X.cve_year(F.col("cve_id")).cast("bigint").alias("label")
    asked = _items(spark, sf_dir, every).select(F.col("item_id").alias("key"), "text", year)
    return asked, table(spark, sf_dir, "ev_pairs").select(F.col("pair_id").alias("key"), F.col("vulnerability_text").alias("text"), year)


def _k1(variant: str) -> float:
    return 1.2 if variant == "smoke" else 1.5


def _scores(spark: SparkSession, sf_dir: str, variant: str, keep: int, high: bool = False, every: bool = False) -> DataFrame:
    asked, corpus = _texts(spark, sf_dir, every)
    return R.bm25_scores(asked.drop("label"), corpus.drop("label"), variant, k1=_k1(variant), keep=keep, high=high)


def _gold_ranks(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    """Ranks of the gold of every query: of the documents whose identifier has the item's year, the test tables link the two in no other way."""
    return R.Bm25(*_texts(spark, sf_dir), [(variant, _k1(variant))]).ranks()


def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vulnerability texts of every item by Okapi BM25."""
    return R.top_k(_scores(spark, sf_dir, "okapi", 10, every=True), 10)


def bm25_plus_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an inverse frequency that is never negative."""
    return R.top_k(_scores(spark, sf_dir, "plus", 10, every=True), 10)


def bm25_smoke_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each query word once and k1 = 1.2."""
    return R.top_k(_scores(spark, sf_dir, "smoke", 10, every=True), 10)


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten by two lexical scores, each scaled a query and summed with equal weight."""
    asked, corpus = _texts(spark, sf_dir)
    return R.top_k(R.Bm25(asked.drop("label"), corpus.drop("label"), [(v, _k1(v)) for v in ("okapi", "smoke")]).fused(10), 10)


def rank_tie_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the gold of every query: by id among ties, and its best and worst."""
    return _gold_ranks(spark, sf_dir, "plus")


def ir_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and gain by source; a query whose gold has no score counts in the denominator."""
    items = table(spark, sf_dir, "task1_cve_linkage").filter("item_id % 20 = 0").select(F.col("item_id").alias("q"), "source")
    return M.ir_metrics(items.join(rank_tie_bounds(spark, sf_dir), "q", "left"), ["source"])


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 20, itself included."""
    e = table(spark, sf_dir, "embeddings")
    return R.dense_top_k(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 10)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of the events of every type with a 95 % interval from 10,000 resamples of daily means."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.to_date("ts")).alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    return M.bootstrap_mean(daily, "event_type", "day", "v", 10_000)


def multiclass_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the title cascade for every class."""
    rows = table(spark, sf_dir, "task2_exploit_type").select("label", F.coalesce(X.title_class(F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\n]*)", 1)), F.lit("none")).alias("predicted"))
    return M.class_f1(rows, "label", "predicted")


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the cascade with the label: observed, Cohen's kappa, Krippendorff's alpha, AC1 and PABAK."""
    rows = table(spark, sf_dir, "task2_exploit_type").select("label", F.coalesce(X.title_class(F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\n]*)", 1)), F.lit("none")).alias("predicted"))
    return M.agreement(rows, "label", "predicted")


def binary_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the number of structural patterns as a score for the pair label, by rank sums over distinct scores."""
    rows = table(spark, sf_dir, "ev_pairs").select("label", X.actionable_count(F.coalesce("exploit_text", F.lit(""))).alias("score"))
    return M.auc(rows, "label", "score")


def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation over seeds of a metric by type of event; 0 for one seed."""
    per_seed = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / n_rows()).alias("m"))
    return per_seed.groupBy("event_type").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 4).alias("sd"), n_rows().alias("seeds"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported and recomputed rows of every source with a tolerance flag."""
    posts = table(spark, sf_dir, "forum_posts").groupBy("source_dataset").agg(n_rows().alias("recomputed"))
    stats = table(spark, sf_dir, "unified_stats").groupBy("source_dataset").agg(F.sum("input_rows").alias("reported"))
    out = stats.join(posts, "source_dataset", "full").select("source_dataset", F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("recomputed", F.lit(0)).alias("recomputed"))
    return out.withColumn("within", F.abs(F.col("reported") - F.col("recomputed")) <= 0.01 * F.col("reported"))


def overlap_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose two texts share a span of 20 characters, and those that do not, by label."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 19)), lambda i: F.substring(c, i, F.lit(20)))
    rows = table(spark, sf_dir, "ev_pairs").filter("exploit_text is not null and vulnerability_text is not null").select("label", F.lower("exploit_text").alias("a"), F.lower("vulnerability_text").alias("b"))
    shared = (F.length("a") >= 20) & (F.length("b") >= 20) & F.arrays_overlap(grams(F.col("a")), grams(F.col("b")))
    return rows.groupBy("label", shared.alias("overlap")).agg(n_rows().alias("n"))


QUERIES = {f.__name__: f for f in (bm25_okapi_topk, bm25_plus_topk, bm25_smoke_topk, hybrid_fusion, rank_tie_bounds, ir_metrics_by_source, embedding_topk, bootstrap_ci, multiclass_f1, kappa, binary_auc, seed_aggregate, reconciliation, overlap_strata)}


def _bm25_sql(variant: str, k1: float, some: str = f"where {TWENTIETH}") -> str:
    post = lambda t, k, c, f: f"(select key, tok, count(*) as tf from (select {k} as key, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9_./:-]+')) as tok from {t} {f}) group by 1, 2)"
    raw = "ln(n - df + 0.5::double) - ln(df + 0.5::double)"
    idf = f"case when {raw} < 0 then 0.25::double * (select sum({raw}) / count(*) from f, s) else {raw} end" if variant == "okapi" else "ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0::double)"
    m = "1" if variant == "smoke" else "q.tf"
    return f"""d as {post('ev_pairs', 'pair_id', 'vulnerability_text', '')}, q as {post('task1_cve_linkage', 'item_id', 'text', some)}, l as (select key, sum(tf)::double as len from d group by 1), s as (select count(*)::double as n, avg(len) as al from l), f as (select tok, count(*)::double as df from d group by 1),
w as (select d.tok, d.key as d, ({idf}) * d.tf * {k1 + 1}::double / (d.tf + {k1}::double * (0.25::double + 0.75::double * len / al)) as w from d join l on d.key = l.key join f on d.tok = f.tok, s), {variant} as (select q.key as q, w.d, round(sum({m} * w.w), 6) as score from q join w on q.tok = w.tok group by 1, 2)"""


_top = lambda t: f"select * from (select q, d, score, row_number() over (partition by q order by score desc, d)::int as place from {t}) where place <= 10"
_gold_sql = r"g as (select i.item_id as q, p.pair_id as d from task1_cve_linkage i join ev_pairs p on substr(i.cve_id, 5, 4) = substr(p.cve_id, 5, 4) where item_id % 20 = 0)"
_ranks = f"""{_bm25_sql('plus', 1.5)}, {_gold_sql}, b as (select plus.q, arg_max(plus.d, struct_pack(a := score, b := -plus.d)) as gd, max(score) as gs from plus join g on plus.q = g.q and plus.d = g.d group by 1),
r as (select p.q, count(*) filter (score > gs) + count(*) filter (score = gs and d < gd) + 1 as rank, count(*) filter (score > gs) + 1 as rank_opt, count(*) filter (score >= gs) as rank_pes from plus p join b on p.q = b.q group by 1)"""
_ends = lambda t, n: f"(select q, d, coalesce((score - min(score) over (partition by q)) / nullif(max(score) over (partition by q) - min(score) over (partition by q), 0), 0) as {n} from {t})"
_pred = f"""(select label, coalesce(case {" ".join(f"when {' or '.join(f"contains(p, '{k}')" for k in ks)} then '{n}'" for n, ks in X.TITLE_CLASSES)} end, 'none') as predicted from (select label, lower(case when instr(f, ' - ') > 0 then substr(f, instr(f, ' - ') + 3) else f end) as p from (select label, split_part(coalesce(text, ''), chr(10), 1) as f from task2_exploit_type)))"""
_act = " + ".join(f"regexp_matches(coalesce(exploit_text, ''), '{p.replace(chr(39), chr(39) * 2)}')::int" for p in X.ACTIONABLE)
SQL = {
    "bm25_okapi_topk": f"with {_bm25_sql('okapi', 1.5, '')} {_top('okapi')}",
    "bm25_plus_topk": f"with {_bm25_sql('plus', 1.5, '')} {_top('plus')}",
    "bm25_smoke_topk": f"with {_bm25_sql('smoke', 1.2, '')} {_top('smoke')}",
    "hybrid_fusion": f"""with o as (with {_bm25_sql('okapi', 1.5)} select * from okapi), k as (with {_bm25_sql('smoke', 1.2)} select * from smoke),
h as (select coalesce(x.q, y.q) as q, coalesce(x.d, y.d) as d, round(0.5::double * coalesce(x, 0) + 0.5::double * coalesce(y, 0), 6) as score from {_ends('o', 'x')} x full join {_ends('k', 'y')} y on x.q = y.q and x.d = y.d) {_top('h')}""",
    "rank_tie_bounds": f"with {_ranks} select * from r",
    "ir_metrics_by_source": f"""with {_ranks} select source, count(*) as n, round(avg(coalesce((rank <= 1)::int, 0)), 6) as recall_1, round(avg(coalesce((rank <= 5)::int, 0)), 6) as recall_5, round(avg(coalesce((rank <= 10)::int, 0)), 6) as recall_10, round(avg(case when rank <= 10 then 1.0::double / rank else 0 end), 6) as mrr_10,
round(avg(case when rank <= 10 then 1.0::double / log2(rank + 1) else 0 end), 6) as ndcg_10, round(avg(case when rank is not null then 1.0::double / rank else 0 end), 6) as map, count(*) filter (rank_pes > rank_opt) as ties, count(*) filter (rank is null) as missing from task1_cve_linkage i left join r on i.item_id = r.q where item_id % 20 = 0 group by 1""",
    "embedding_topk": """with v as (select vec_id, embedding::double[] as e from embeddings), u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
s as (select a.vec_id as q, b.vec_id as d, round(list_dot_product(a.e, b.e), 6) as score from u a, u b where a.vec_id % 20 = 0) select * from (select q, d, score, row_number() over (partition by q order by score desc, d)::int as place from s) where place <= 10""",
    "bootstrap_ci": """with r as (select event_type as grp, date_diff('day', date '1970-01-01', ts::date) as unit, sum(round(value * 100)::bigint)::bigint as v from events group by 1, 2), k as (select grp, v, row_number() over (partition by grp order by unit) as i, count(*) over (partition by grp) as n from r),
x as (select k.grp, rep, 1 + ('0x' || substr(md5(k.grp || '|' || rep::varchar || '|' || i::varchar), 1, 8))::bigint % n as pick from k, range(10000) t(rep)), m as (select x.grp, rep, sum(k.v)::double / count(*) as mean from x join k on x.grp = k.grp and x.pick = k.i group by 1, 2)
select m.grp, round(any_value(a), 4) as mean, round(quantile_cont(m.mean, 0.025), 4) as low, round(quantile_cont(m.mean, 0.975), 4) as high from m join (select grp, sum(v)::double / count(*) as a from r group by 1) a on m.grp = a.grp group by 1""",
    "multiclass_f1": f"""with c as (select label as y, predicted as p, count(*) as n from {_pred} group by 1, 2), k as (select y as class from c union select p from c), t as (select class, coalesce((select sum(n) from c where y = class and p = class), 0)::bigint as tp, coalesce((select sum(n) from c where y = class), 0)::bigint as support, coalesce((select sum(n) from c where p = class), 0)::bigint as predicted from k)
select class, tp, support, predicted, round(coalesce(tp::double / nullif(predicted, 0), 0), 6) as "precision", round(coalesce(tp::double / nullif(support, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(support + predicted, 0), 0), 6) as f1 from t""",
    "kappa": f"""with c as (select label as y, predicted as p, count(*) as n from {_pred} group by 1, 2), k as (select y as class from c union select p from c), n as (select sum(n)::double as n, sum(n) filter (y = p)::double as same from c),
m as (select class, coalesce((select sum(n) from c where y = class), 0)::double as a, coalesce((select sum(n) from c where p = class), 0)::double as b from k), e as (select sum(a * b) as ab, sum((a + b) / 2 / n.n * (1 - (a + b) / 2 / n.n)) as g, count(*) as k, sum((a + b) * (a + b - 1)) as cc from m, n)
select n.n::bigint as n, round(same / n.n, 6) as observed, round((same / n.n - ab / n.n / n.n) / (1 - ab / n.n / n.n), 6) as kappa, round(1 - (1 - same / n.n) / (1 - cc / (2 * n.n * (2 * n.n - 1))), 6) as alpha, round((same / n.n - g / (k - 1)) / (1 - g / (k - 1)), 6) as ac1, round((k * same / n.n - 1) / (k - 1), 6) as pabak from n, e""",
    "binary_auc": f"""with r as (select label, {_act} as s from ev_pairs), c as (select s, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from r group by 1), u as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from c)
select sum(p)::bigint as positives, sum(n)::bigint as negatives, round(sum(p * (below + n / 2.0::double)) / (sum(p) * sum(n)), 6) as auc from u""",
    "seed_aggregate": "with s as (select event_type, user_id % 5 as seed, sum(round(value * 100)::bigint)::double / count(*) as m from events group by 1, 2) select event_type, round(avg(m), 4) as mean, round(coalesce(stddev_samp(m), 0), 4) as sd, count(*) as seeds from s group by 1",
    "reconciliation": """with p as (select source_dataset, count(*) as recomputed from forum_posts group by 1), s as (select source_dataset, sum(input_rows)::bigint as reported from unified_stats group by 1)
select coalesce(s.source_dataset, p.source_dataset) as source_dataset, coalesce(reported, 0) as reported, coalesce(recomputed, 0) as recomputed, abs(coalesce(reported, 0) - coalesce(recomputed, 0)) <= 0.01 * coalesce(reported, 0) as within from s full join p on s.source_dataset = p.source_dataset""",
    "overlap_strata": """with r as (select label, lower(exploit_text) as a, lower(vulnerability_text) as b from ev_pairs where exploit_text is not null and vulnerability_text is not null),
s as (select label, len(a) >= 20 and len(b) >= 20 and list_has_any([substr(a, i, 20) for i in range(1, greatest(1, length(a) - 19) + 1)], [substr(b, i, 20) for i in range(1, greatest(1, length(b) - 19) + 1)]) as overlap from r) select label, overlap, count(*) as n from s group by 1, 2""",
}
