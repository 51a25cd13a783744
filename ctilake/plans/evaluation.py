"""Evaluation: hybrid ranking, paired and classification bootstraps, strata, judge summaries, audits of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions import judge as J
from ctilake.functions import text as X
from ctilake.functions.common import filled, n_rows
from ctilake.operators import metrics as M
from ctilake.operators import retrieval as R
from ctilake.operators.sampling import round_robin
from ctilake.plans.corpus import dedup_source_stats
from ctilake.plans.retrieval import TWENTIETH, _items, _k1, _scores, _texts, rank_tie_bounds
from ctilake.sources.tables import broadcast_if_small, cut, table

REPLICATES, F1_REPLICATES = 10_000, 2_000


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.count()


def _unit(vectors: DataFrame) -> DataFrame:
    v = cut(vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("vec_id", F.transform("v", lambda x: x / norm).alias("v"))


def _with_vectors(scores: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Scores with the cosine of query and document; the tables hold no vectors of texts, so a key stands for the vector of its remainder."""
    unit = _unit(vectors)
    q, d = unit.select(F.col("vec_id").alias("qv"), F.col("v").alias("a")), unit.select(F.col("vec_id").alias("dv"), F.col("v").alias("b"))
    both = scores.withColumn("qv", F.col("q") % n).withColumn("dv", F.col("d") % n).join(broadcast_if_small(q), "qv").join(broadcast_if_small(d), "dv")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("q", "d", "score", F.round(dot, 6).alias("cos"))


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten of the hundred best lexical documents of every query by 0.7 of the cosine and 0.3 of the lexical score, both scaled to 0..1."""
    vectors, n = _vectors(spark, sf_dir)
    top = cut(R.top_k(_scores(spark, sf_dir, "okapi", 100), 100))
    return R.top_k(_mixed(top.select("q", "d", "score"), vectors, n), 10)


def _mixed(scores: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    top = scores.groupBy("q").agg(F.max("score").alias("best"))
    lexical = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score"))
    both = _with_vectors(scores, vectors, n).join(top, "q")
    return both.select("q", "d", F.round(0.7 * (F.col("cos") + 1) / 2 + 0.3 * lexical, 6).alias("score"))


def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten of all documents with a lexical score by the same mixture, for every item."""
    vectors, n = _vectors(spark, sf_dir)
    unit = broadcast_if_small(_unit(vectors).filter("v is not null").select("vec_id", F.col("v").alias("vectors")))
    asked, corpus = (t.select("key", "text", (F.col("key") % n).alias("vec_id")).join(unit, "vec_id").drop("vec_id") for t in _texts(spark, sf_dir, every=True))
    return R.top_k(R.Bm25(asked, corpus, [("okapi", 1.5)]).with_vectors(10), 10)


def top_k_high_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every query where ties go to the higher key."""
    w = W.partitionBy("q").orderBy(F.desc("score"), F.desc("d"))
    return _scores(spark, sf_dir, "plus", 10, high=True).withColumn("place", F.row_number().over(w)).filter("place <= 10")


def _reciprocals(spark: SparkSession, sf_dir: str, variants: tuple[str, ...], every: bool = False) -> dict[str, DataFrame]:
    """(q, rr) by scorer; documents are read and postings matched once for all."""
    ranks = cut(R.Bm25(*_texts(spark, sf_dir, every), [(v, _k1(v)) for v in variants]).ranks_by_scorer())
    return {v: _reciprocal(spark, sf_dir, ranks.filter(F.col("s") == i), every) for i, v in enumerate(variants)}


def _reciprocal(spark: SparkSession, sf_dir: str, ranks: DataFrame, every: bool) -> DataFrame:
    items = _items(spark, sf_dir, every).select(F.col("item_id").alias("q"))
    return items.join(ranks, "q", "left").select("q", F.when(F.col("rank") <= 10, F.floor(F.lit(1_000_000) / F.col("rank"))).otherwise(0).cast("bigint").alias("rr"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of reciprocal rank (in millionths) of two scorers over every item, with a 95 % interval of 10,000 resamples that both share."""
    runs = _reciprocals(spark, sf_dir, ("plus", "okapi"), every=True)
    a, b = runs["plus"].withColumnRenamed("rr", "x"), runs["okapi"].withColumnRenamed("rr", "y")
    delta = cut(a.join(b, "q").select(F.lit("plus - okapi").alias("pair"), "q", (F.col("x") - F.col("y")).alias("v")))
    out = M.bootstrap_mean(delta, "pair", "q", "v", REPLICATES)
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract(filled(), r"^([^\n]*)", 1)
    return table(spark, sf_dir, "task2_exploit_type").select("rec_id", F.col("_split").alias("split"), "source", "label", F.coalesce(X.title_class(title), F.lit("none")).alias("predicted"))


def f1_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of the title cascade on the test records and its 95 % interval by 2,000 resamples of records."""
    return M.bootstrap_macro_f1(_predicted(spark, sf_dir).filter("split = 'test'"), "rec_id", "label", "predicted", F1_REPLICATES)


def f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, accuracy, macro and weighted F1 of the cascade by split."""
    return M.f1_summary(_predicted(spark, sf_dir), ["split"], "label", "predicted")


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of "at least three structural patterns" as a guess at the pair label."""
    guess = (X.actionable_count(filled("exploit_text")) >= 3).cast("int")
    c = table(spark, sf_dir, "ev_pairs").select("label", guess.alias("g")).agg(*[F.count_if((F.col("label") == y) & (F.col("g") == p)).alias(n) for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", r(tp + tn, tp + fp + fn + tn).alias("accuracy"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def source_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right classes by source with a band of risk."""
    p = F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 4)
    out = _predicted(spark, sf_dir).groupBy("source").agg(n_rows().alias("n"), p.alias("precision"))
    return out.withColumn("risk", F.when(F.col("precision") >= 0.9, "low").when(F.col("precision") >= 0.7, "medium").otherwise("high"))


def joint_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries classified as actionable, those whose gold is in the best ten, and both, with the recall of both together."""
    items = table(spark, sf_dir, "task1_cve_linkage").filter("item_id % 20 = 0").select(F.col("item_id").alias("q"), (X.actionable_count(filled()) > 0).alias("actionable"))
    r = items.join(rank_tie_bounds(spark, sf_dir), "q", "left").withColumn("hit", F.coalesce(F.col("rank") <= 10, F.lit(False)))
    return r.agg(n_rows().alias("n"), F.count_if("actionable").alias("actionable"), F.count_if("hit").alias("retrieved"), F.count_if(F.col("actionable") & F.col("hit")).alias("joint"), F.round(F.count_if(F.col("actionable") & F.col("hit")) / n_rows(), 6).alias("joint_recall"))


def cyrillic_share(text: Column) -> Column:
    """Share of Cyrillic letters; 0 for an empty text."""
    return F.coalesce(F.try_divide((F.length(text) - F.length(F.regexp_replace(text, "[\\u0400-\\u04FF]", ""))).cast("double"), F.length(text)), F.lit(0.0))


def shortcut_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a query gives its answer away, by split: the gold's identifier, any identifier, an address, a version, Cyrillic text."""
    t = filled()
    named = F.upper(t).contains(F.upper(F.coalesce("cve_id", F.lit("?"))))
    return table(spark, sf_dir, "task1_cve_linkage").groupBy("split").agg(
        n_rows().alias("n"), F.count_if(named).alias("names_gold"), F.count_if(t.rlike(r"(?i)CVE[-\s]?\d{4}[-\s]?\d{4,7}")).alias("names_any"), F.count_if(t.rlike(r"https?://\S+")).alias("has_url"), F.count_if(t.rlike(r"\b\d+(?:\.\d+){1,}")).alias("has_version"), F.count_if(cyrillic_share(t) > 0.05).alias("cyrillic_heavy"),
    )


def strata_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics of queries with and without a span of twelve characters that the query shares with a gold text."""
    asked, corpus = _texts(spark, sf_dir)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 11)), lambda i: F.xxhash64(F.substring(c, i, F.lit(12))))
    of = lambda df, *key: df.select("label", *key, F.lower("text").alias("t")).distinct().filter(F.length("t") >= 12).select("label", *key, F.explode(F.array_distinct(grams(F.col("t")))).alias("x"))
    # a span of a gold text is one of any text of the query's label, so that no pair of query and gold is made
    shared = of(asked.withColumnRenamed("key", "q"), "q").join(of(corpus).distinct(), ["label", "x"], "left_semi").select("q").distinct().withColumn("overlap", F.lit(True))
    items = asked.select(F.col("key").alias("q"))
    flagged = items.select("q").join(shared, "q", "left").select("q", F.coalesce("overlap", F.lit(False)).alias("overlap"))
    return M.ir_metrics(flagged.join(rank_tie_bounds(spark, sf_dir), "q", "left"), ["overlap"])


def span_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters left of every exploit text when those in a run of twenty that its vulnerability text holds become blanks."""
    rows = table(spark, sf_dir, "ev_pairs").filter("exploit_text is not null and vulnerability_text is not null").select("pair_id", F.lower("exploit_text").alias("q"), F.lower("vulnerability_text").alias("g"))
    return rows.select("pair_id", F.length("q").alias("before"), F.length(F.replace(J.strip_spans(F.col("q"), F.col("g")), F.lit(" "), F.lit(""))).alias("left"))


def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of every (type, seed): the row written last wins; ties by id."""
    e = table(spark, sf_dir, "events").withColumn("seed", F.col("user_id") % 5)
    return e.groupBy("event_type", "seed").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over seeds with the sample deviation, null where there is one seed."""
    per_seed = table(spark, sf_dir, "events").withColumn("seed", F.when(F.col("event_type") == "error", 0).otherwise(F.col("user_id") % 5)).groupBy("event_type", "seed").agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / n_rows()).alias("m"))
    return per_seed.groupBy("event_type").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.when(n_rows() > 1, F.stddev_samp("m")), 4).alias("sd"), n_rows().alias("seeds"))


def _packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet of two judges' answers, made from the pairs by arithmetic on their keys, as the tables hold none."""
    k = F.col("pair_id")
    answer = lambda n: F.concat(F.lit("Sure.\n```json\n{\"label\": \""), F.when((k * n) % 5 < 2, "yes").when((k * n) % 5 < 4, "no").otherwise("Exploit_Relevant"), F.lit("\", \"needs_human_review\": "), F.when((k * n) % 9 == 0, '"true"').otherwise("false"), F.lit("}\n```"))
    rows = table(spark, sf_dir, "ev_pairs").select("pair_id", F.col("label").cast("string").alias("benchmark_label"), F.when(k % 7 == 0, "error").otherwise("ok").alias("a_status"), F.when(k % 11 == 0, "error").otherwise("ok").alias("b_status"), answer(3).alias("a"), answer(7).alias("b"))
    for c in ("a", "b"):
        rows = rows.withColumn(f"{c}_label", J.task_label(J.json_field(F.col(c), "label"))).withColumn(f"{c}_review", J.bool_of(J.json_field(F.col(c), "needs_human_review")))
    return rows


def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, consensus and disagreement rows of two judges, agreement with the benchmark, and rows that need a person."""
    done = (F.col("a_status") == "ok") & (F.col("b_status") == "ok")
    same = done & (F.col("a_label") == F.col("b_label"))
    right = same & (F.col("a_label") == F.col("benchmark_label"))
    review = done & (F.coalesce("a_review", F.lit(False)) | F.coalesce("b_review", F.lit(False)) | (F.col("a_label") != F.col("b_label")))
    out = _packet(spark, sf_dir).agg(n_rows().alias("n_rows"), F.count_if(done).alias("completed"), F.count_if(same).alias("consensus"), F.count_if(right).alias("agreements"), F.count_if(review).alias("needs_human_review"))
    return out.select("n_rows", "completed", "consensus", (F.col("completed") - F.col("consensus")).alias("disagreement"), F.round(F.try_divide("agreements", "consensus"), 4).alias("agreement_on_consensus"), "needs_human_review", F.lit(False).alias("human_labels_present"))


def packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed and auditable rows of a manual packet, the agreement rate, and whether it is complete."""
    note = F.when(F.col("pair_id") % 4 == 0, "").when(F.col("pair_id") % 4 == 1, "yes").when(F.col("pair_id") % 4 == 2, "0")
    rows = table(spark, sf_dir, "ev_pairs").select(F.col("label").cast("string").alias("benchmark_label"), note.alias("annotator_label"))
    done = F.col("annotator_label").isNotNull() & (F.col("annotator_label") != "")
    said = F.when(F.col("annotator_label").isin("1", "yes", "true", "exploit_relevant"), "1").otherwise("0")
    out = rows.agg(n_rows().alias("n_rows"), F.count_if(done).alias("completed"), F.count_if(done & (said == F.col("benchmark_label"))).alias("agreements"))
    return out.select("n_rows", "completed", F.round(F.try_divide("agreements", "completed"), 4).alias("agreement"), F.when((F.col("completed") == F.col("n_rows")) & (F.col("n_rows") > 0), "complete").otherwise("annotation_pending").alias("status"))


def cross_task_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two tasks share, for every pair of tasks in name order."""
    one = lambda name, t, c: table(spark, sf_dir, t).select(F.lit(name).alias("task"), X.normal(filled(c)).alias("n")).filter("n <> ''").select("task", F.sha2("n", 256).alias("fp")).distinct()
    every = one("task1", "task1_cve_linkage", "text").unionByName(one("task2", "task2_exploit_type", "text")).unionByName(one("task3", "ev_pairs", "exploit_text")).unionByName(one("task4", "ev_pairs", "vulnerability_text"))
    tasks = every.groupBy("fp").agg(F.array_sort(F.collect_set("task")).alias("tasks"))  # at most one entry a task
    a = tasks.filter(F.size("tasks") > 1).select(F.explode("tasks").alias("left_task"), "tasks")
    shared = a.select("left_task", F.explode("tasks").alias("right_task")).filter("left_task < right_task").groupBy("left_task", "right_task").agg(n_rows().alias("shared"))
    names = ["task1", "task2", "task3", "task4"]
    pairs = spark.createDataFrame([(x, y) for x in names for y in names if x < y], "left_task string, right_task string")
    return pairs.join(F.broadcast(shared), ["left_task", "right_task"], "left").select("left_task", "right_task", F.coalesce("shared", F.lit(0)).alias("shared"))


def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items and those of them that the whole table also holds by (id, gold, text) in another row."""
    rows = table(spark, sf_dir, "task1_cve_linkage").select("item_id", "split", "id", "cve_id", X.fingerprint(filled()).alias("fp"))
    n = rows.groupBy("id", "cve_id", "fp").agg(n_rows().alias("_n"))
    held = rows.filter("split <> 'train'").alias("r").join(n.alias("n"), F.col("r.id").eqNullSafe(F.col("n.id")) & F.col("r.cve_id").eqNullSafe(F.col("n.cve_id")) & (F.col("r.fp") == F.col("n.fp")))
    return held.groupBy("r.split").agg(n_rows().alias("items"), F.count_if(F.col("_n") > 1).alias("repeated"))


def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of three result sets aligned by id: rows, ids that all have, and ids that differ."""
    runs = {v: rr.withColumnRenamed("rr", v) for v, rr in _reciprocals(spark, sf_dir, ("okapi", "plus", "smoke")).items()}
    j = runs["okapi"].join(runs["plus"], "q", "full").join(runs["smoke"], "q", "full")
    every = F.col("okapi").isNotNull() & F.col("plus").isNotNull() & F.col("smoke").isNotNull()
    return j.agg(n_rows().alias("n"), F.count_if(every).alias("aligned"), F.count_if(~every).alias("missing"), *[F.sum(v).alias(f"{v}_sum") for v in runs])


def tie_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank over all queries by the decided, the best and the worst rank among ties, with recall at ten of each and the number of ties."""
    items = table(spark, sf_dir, "task1_cve_linkage").filter("item_id % 20 = 0").select(F.col("item_id").alias("q"))
    r = items.join(rank_tie_bounds(spark, sf_dir), "q", "left")
    mean = lambda c, n: F.round(F.avg(F.when(F.col(c).isNotNull(), 1 / F.col(c)).otherwise(0.0)), 6).alias(n)
    hit = lambda c, n: F.round(F.avg(F.when(F.col(c) <= 10, 1.0).otherwise(0.0)), 6).alias(n)
    return r.agg(n_rows().alias("n"), mean("rank", "mrr"), mean("rank_opt", "mrr_opt"), mean("rank_pes", "mrr_pes"), hit("rank", "r10"), hit("rank_opt", "r10_opt"), hit("rank_pes", "r10_pes"), F.count_if(F.col("rank_pes") > F.col("rank_opt")).alias("ties"))


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source as a run reported them, as the posts hold them and as deduplication leaves them, with tolerance flags."""
    stats = table(spark, sf_dir, "unified_stats").groupBy("source_dataset").agg(F.sum("input_rows").alias("reported"), F.sum("written_rows").alias("reported_written"))
    ours = dedup_source_stats(spark, sf_dir).select("source_dataset", F.col("input_rows").alias("held"), F.col("written_rows").alias("written"))
    out = stats.join(ours, "source_dataset", "full").select("source_dataset", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reported", "held", "reported_written", "written")])
    return out.withColumn("rows_agree", F.abs(F.col("reported") - F.col("held")) <= 0.01 * F.col("held")).withColumn("written_agree", F.abs(F.col("reported_written") - F.col("written")) <= 0.05 * F.col("written"))


def manual_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet of sixty records to be judged by hand, drawn in turn from every split and label, with audit ids."""
    rows = table(spark, sf_dir, "task2_exploit_type").select("rec_id", "label", F.col("_split").alias("split"), F.concat_ws("/", "_split", "label").alias("stratum"))
    drawn = round_robin(rows, "stratum", "rec_id", 60)
    place = F.row_number().over(W.orderBy("turn", "stratum"))  # sixty rows
    return drawn.select(F.concat(F.lit("A"), F.lpad(place.cast("string"), 4, "0")).alias("audit_id"), "rec_id", "split", F.col("label").alias("benchmark_label"), F.lit("").alias("annotator_label"))


def _cosine(spark: SparkSession, sf_dir: str, feats, idf: bool = True) -> DataFrame:
    asked, corpus = _texts(spark, sf_dir)
    return R.top_k(R.cosine_scores(asked.drop("label"), corpus.drop("label"), lambda t: feats(F.lower(t)), idf), 10)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./:-]+)"), F.lit(1))


def _in_words(text: Column) -> Column:
    """Runs of three to five characters inside words, their blanks at either end included."""
    padded = F.transform(_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(padded, lambda w: F.concat(runs(w, 3), runs(w, 4), runs(w, 5))))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vulnerability texts of every query by the cosine of TF-IDF over words."""
    return _cosine(spark, sf_dir, _words)


def count_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by plain counts of words."""
    return _cosine(spark, sf_dir, _words, idf=False)


def char_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by TF-IDF over runs of characters inside words."""
    return _cosine(spark, sf_dir, _in_words)


QUERIES = {f.__name__: f for f in (tie_summary, three_way, manual_packet, tfidf_topk, count_topk, char_topk, hybrid_rerank, hybrid_full, top_k_high_ties, paired_bootstrap, f1_bootstrap, f1_summary, binary_metrics, source_risk, joint_recall, shortcut_diagnostics, strata_metrics, span_strip, last_run, seed_spread, judge_summary, packet_summary, cross_task_overlap, subset_check, aligned_runs)}

from ctilake.plans.retrieval import _bm25_sql, _gold_sql, _pred, _ranks, _top  # noqa: E402  the SQL of the same scores

_some = f"where {TWENTIETH}"
_rank_of = lambda v, some=_some: f"""{_bm25_sql(v, 1.2 if v == 'smoke' else 1.5, some)}, {_gold_sql if some else _gold_sql.replace(f" {_some}", "")}, b as (select t.q, arg_max(t.d, struct_pack(a := score, b := -t.d)) as gd, max(score) as gs from {v} t join g on t.q = g.q and t.d = g.d group by 1),
r as (select p.q, count(*) filter (score > gs) + count(*) filter (score = gs and d < gd) + 1 as rank from {v} p join b on p.q = b.q group by 1)"""  # noqa: E731
_rr = lambda v, some=_some: f"(with {_rank_of(v, some)} select item_id as q, case when rank <= 10 then 1000000 // rank else 0 end::bigint as rr from task1_cve_linkage left join r on item_id = r.q {some})"
_cos = "v as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings), nv as (select count(*) as n from embeddings)"
_mix = "h as (select q, d, round(0.7::double * (round(list_dot_product(a.v, b.v), 6) + 1) / 2 + 0.3::double * case when best > 0 then score / best else score end, 6) as score from (select *, max(score) over (partition by q) as best from s), nv, v a, v b where a.vec_id = q % nv.n and b.vec_id = d % nv.n)"
_recs = f"(select rec_id, _split as split, source, t.label, predicted from (select row_number() over () as i, * from task2_exploit_type) t join (select row_number() over () as i, predicted from {_pred}) p on t.i = p.i)"
_cells = "select {by} y as class, sum(n) filter (y = p) as tp, sum(n) as support, 0 as guessed from c group by all union all select {by} p, 0, 0, sum(n) from c group by all"
_pk = "(select pair_id as k, label::varchar as benchmark, pair_id % 7 <> 0 as a_ok, pair_id % 11 <> 0 as b_ok, case when (pair_id * 3) % 5 in (2, 3) then '0' else '1' end as a, case when (pair_id * 7) % 5 in (2, 3) then '0' else '1' end as b, (pair_id * 3) % 9 = 0 as ar, (pair_id * 7) % 9 = 0 as br from ev_pairs)"
_fp = lambda c: rf"trim(regexp_replace(lower(coalesce({c}, '')), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_boot = "1 + ('0x' || substr(md5({k}), 1, 8))::bigint % n as pick"
def _cosine_sql(feats: str, idf: str) -> str:
    side = lambda t, k, c, f: f"(select {k} as key, ('0x' || substr(md5(x), 1, 8))::bigint % 262144 as b, count(*) as tf from (select {k}, {feats.format(f'lower(coalesce({c}, {chr(39) * 2}))')} as x from {t} {f}) group by 1, 2)"
    return f"""with d as {side('ev_pairs', 'pair_id', 'vulnerability_text', '')}, q as {side('task1_cve_linkage', 'item_id', 'text', 'where item_id % 20 = 0')}, s as (select count(distinct key)::double as n from d), f as (select b, count(*)::double as df from d group by 1),
dw as (select d.key, d.b, tf * {idf} as w from d join f on d.b = f.b, s), qw as (select q.key, q.b, tf * {idf} as w from q left join f on q.b = f.b, s), dn as (select key, sqrt(sum(w * w)) as n from dw group by 1), qn as (select key, sqrt(sum(w * w)) as n from qw group by 1),
h as (select qw.key as q, dw.key as d, round(sum(qw.w * dw.w) / any_value(qn.n) / any_value(dn.n), 6) as score from qw join dw on qw.b = dw.b join dn on dn.key = dw.key join qn on qn.key = qw.key group by 1, 2) {_top('(select * from h where score > 0)')}"""


_idf = "(ln((1 + s.n) / (1 + coalesce(f.df, 0))) + 1.0::double)"
SQL = {
    "tie_summary": f"""with {_ranks} select count(*) as n, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr, round(avg(coalesce(1.0::double / rank_opt, 0)), 6) as mrr_opt, round(avg(coalesce(1.0::double / rank_pes, 0)), 6) as mrr_pes, round(avg(coalesce((rank <= 10)::int, 0)), 6) as r10, round(avg(coalesce((rank_opt <= 10)::int, 0)), 6) as r10_opt, round(avg(coalesce((rank_pes <= 10)::int, 0)), 6) as r10_pes,
count(*) filter (rank_pes > rank_opt) as ties from task1_cve_linkage i left join r on i.item_id = r.q where item_id % 20 = 0""",
    "three_way": f"""with r as (select post_key, source_dataset, nullif({_fp('text')}, '') as n from forum_posts), f as (select arg_min(source_dataset, post_key) as source_dataset from r where n is not null group by n), w as (select source_dataset, count(*) as w from f group by 1), h as (select r.source_dataset, count(*) as h from r group by 1),
s as (select source_dataset, sum(input_rows)::bigint as i, sum(written_rows)::bigint as o from unified_stats group by 1), j as (select coalesce(s.source_dataset, h.source_dataset) as source_dataset, coalesce(i, 0) as reported, coalesce(h, 0) as held, coalesce(o, 0) as reported_written, coalesce(w, 0) as written from s full join h on s.source_dataset = h.source_dataset left join w on w.source_dataset = h.source_dataset)
select *, abs(reported - held) <= 0.01 * held as rows_agree, abs(reported_written - written) <= 0.05 * written as written_agree from j""",
    "manual_packet": "with k as (select rec_id, label, _split, concat_ws('/', _split, label) as stratum, row_number() over (partition by concat_ws('/', _split, label) order by md5('42|' || rec_id::varchar), rec_id) as turn from task2_exploit_type), p as (select *, row_number() over (order by turn, stratum) as place from k) select 'A' || lpad(place::varchar, 4, '0') as audit_id, rec_id, _split as split, label as benchmark_label, '' as annotator_label from p where place <= 60",
    "tfidf_topk": _cosine_sql("unnest(regexp_extract_all({}, '[A-Za-z0-9_./:-]+'))", _idf),
    "count_topk": _cosine_sql("unnest(regexp_extract_all({}, '[A-Za-z0-9_./:-]+'))", "1.0::double"),
    "char_topk": _cosine_sql("unnest(flatten(list_transform(regexp_extract_all({}, '[A-Za-z0-9_./:-]+'), lambda w: flatten([[substr(' ' || w || ' ', i, n) for i in range(1, length(w) + 4 - n)] for n in [3, 4, 5]]))))", _idf),
    "hybrid_rerank": f"with {_cos}, t as (select * from (with {_bm25_sql('okapi', 1.5)} select * from okapi)), s as (select q, d, score from (select *, row_number() over (partition by q order by score desc, d) as rn from t) where rn <= 100), {_mix} {_top('h')}",
    "hybrid_full": f"with {_cos}, s as (select * from (with {_bm25_sql('okapi', 1.5, '')} select * from okapi)), {_mix} {_top('h')}",
    "top_k_high_ties": f"with {_bm25_sql('plus', 1.5)} select * from (select q, d, score, row_number() over (partition by q order by score desc, d desc)::int as place from plus) where place <= 10",
    "paired_bootstrap": f"""with d as (select 'plus - okapi' as grp, a.q, a.rr - b.rr as v from {_rr('plus', '')} a join {_rr('okapi', '')} b on a.q = b.q), k as (select grp, v, row_number() over (order by q) as i, count(*) over () as n from d),
x as (select rep, {_boot.format(k="k.grp || '|' || rep::varchar || '|' || i::varchar")} from k, range(10000) t(rep)), m as (select rep, sum(v)::double / count(*) as m from x join k on pick = i group by 1), e as (select round(quantile_cont(m, 0.025), 4) as low, round(quantile_cont(m, 0.975), 4) as high from m)
select 'plus - okapi' as grp, round((select sum(v)::double / count(*) from d), 4) as mean, low, high, low > 0 or high < 0 as excludes_zero from e""",
    "f1_bootstrap": f"""with k as (select label as y, predicted as p, row_number() over (order by rec_id) as i, count(*) over () as n from {_recs} where split = 'test'),
x as (select rep, {_boot.format(k="'f1|' || rep::varchar || '|' || i::varchar")} from k, range(2000) t(rep)), c as (select rep, y, p, count(*) as n from x join k on pick = i group by 1, 2, 3 union all select -1, y, p, count(*) from k group by 1, 2, 3),
u as (select rep, class, sum(tp) as tp, sum(support) as support, sum(guessed) as guessed from ({_cells.format(by='rep,')}) group by 1, 2), m as (select rep, sum(case when support > 0 then 2.0::double * coalesce(tp, 0) / (support + guessed) else 0 end) / (select count(distinct y) from k) as m from u group by 1)
select (select count(*) from k) as n, round(max(m) filter (rep < 0), 6) as macro_f1, round(quantile_cont(m, 0.025) filter (rep >= 0), 6) as low, round(quantile_cont(m, 0.975) filter (rep >= 0), 6) as high from m""",
    "f1_summary": f"""with c as (select split, label as y, predicted as p, count(*) as n from {_recs} group by 1, 2, 3), u as (select split, class, coalesce(sum(tp), 0) as tp, sum(support) as support, sum(guessed) as guessed from ({_cells.format(by='split,')}) group by 1, 2), f as (select *, 2.0::double * tp / (support + guessed) as f1 from u)
select split, sum(support)::bigint as n, round(sum(tp)::double / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f group by 1""",
    "binary_metrics": r"""with r as (select label = 1 as y, (regexp_matches(t, '(?i)\\x[0-9a-f]{2}')::int + regexp_matches(t, '0x[0-9a-fA-F]{4,}')::int + regexp_matches(t, '(?i)\b(exploit|payload|shellcode|PoC|proof.of.concept)\b')::int + regexp_matches(t, '(?i)\b(metasploit|msfconsole|msfvenom)\b')::int + regexp_matches(t, '(?i)\b(curl|wget|nc|netcat|nmap)\s+')::int + regexp_matches(t, '(?i)(GET|POST|PUT|DELETE)\s+/\S+\s+HTTP')::int
 + regexp_matches(t, '(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\s+.*(FROM|INTO|TABLE|ALL)')::int + regexp_matches(t, '(?is)<script[^>]*>.*?</script>')::int + regexp_matches(t, '(?i)(def |import |require\(|#include|public class|void main)')::int + regexp_matches(t, '(?i)/bin/(sh|bash|zsh|cmd)')::int + regexp_matches(t, 'CVE-\d{4}-\d{4,}')::int) >= 3 as p from (select label, coalesce(exploit_text, '') as t from ev_pairs)),
c as (select count(*) filter (y and p) as tp, count(*) filter (not y and p) as fp, count(*) filter (y and not p) as fn, count(*) filter (not y and not p) as tn from r) select *, round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c""",
    "source_risk": f"""with p as (select source, count(*) as n, round(avg((label = predicted)::int), 4) as "precision" from {_recs} group by 1) select *, case when "precision" >= 0.9 then 'low' when "precision" >= 0.7 then 'medium' else 'high' end as risk from p""",
    "joint_recall": rf"""with {_ranks}, j as (select coalesce(rank <= 10, false) as hit, regexp_matches(t, '(?i)\\x[0-9a-f]{{2}}') or regexp_matches(t, '0x[0-9a-fA-F]{{4,}}') or regexp_matches(t, '(?i)\b(exploit|payload|shellcode|PoC|proof.of.concept)\b') or regexp_matches(t, '(?i)\b(metasploit|msfconsole|msfvenom)\b') or regexp_matches(t, '(?i)\b(curl|wget|nc|netcat|nmap)\s+') or regexp_matches(t, '(?i)(GET|POST|PUT|DELETE)\s+/\S+\s+HTTP') or regexp_matches(t, '(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\s+.*(FROM|INTO|TABLE|ALL)')
 or regexp_matches(t, '(?is)<script[^>]*>.*?</script>') or regexp_matches(t, '(?i)(def |import |require\(|#include|public class|void main)') or regexp_matches(t, '(?i)/bin/(sh|bash|zsh|cmd)') or regexp_matches(t, 'CVE-\d{{4}}-\d{{4,}}') as act from (select item_id, coalesce(text, '') as t from task1_cve_linkage where item_id % 20 = 0) i left join r on item_id = r.q)
select count(*) as n, count(*) filter (act) as actionable, count(*) filter (hit) as retrieved, count(*) filter (act and hit) as joint, round(count(*) filter (act and hit)::double / count(*), 6) as joint_recall from j""",
    "shortcut_diagnostics": r"""with r as (select split, coalesce(text, '') as t, upper(coalesce(cve_id, '?')) as g from task1_cve_linkage) select split, count(*) as n, count(*) filter (contains(upper(t), g)) as names_gold, count(*) filter (regexp_matches(t, '(?i)CVE[-\s]?\d{4}[-\s]?\d{4,7}')) as names_any, count(*) filter (regexp_matches(t, 'https?://\S+')) as has_url, count(*) filter (regexp_matches(t, '\b\d+(?:\.\d+){1,}')) as has_version,
count(*) filter (length(t) > 0 and (length(t) - length(regexp_replace(t, '[\x{0400}-\x{04FF}]', '', 'g')))::double / length(t) > 0.05) as cyrillic_heavy from r group by 1""",
    "strata_metrics": f"""with {_ranks}, a as (select distinct item_id as q, unnest([substr(lower(coalesce(text, '')), i, 12) for i in range(1, length(coalesce(text, '')) - 10)]) as x from task1_cve_linkage where item_id % 20 = 0), c as (select distinct q, unnest([substr(t, i, 12) for i in range(1, length(t) - 10)]) as x from (select distinct g.q, lower(coalesce(vulnerability_text, '')) as t from g join ev_pairs on d = pair_id)),
ov as (select distinct a.q from a join c on a.q = c.q and a.x = c.x), fl as (select item_id as q, item_id in (select q from ov) as overlap from task1_cve_linkage where item_id % 20 = 0)
select overlap, count(*) as n, round(avg(coalesce((rank <= 1)::int, 0)), 6) as recall_1, round(avg(coalesce((rank <= 5)::int, 0)), 6) as recall_5, round(avg(coalesce((rank <= 10)::int, 0)), 6) as recall_10, round(avg(case when rank <= 10 then 1.0::double / rank else 0 end), 6) as mrr_10, round(avg(case when rank <= 10 then 1.0::double / log2(rank + 1) else 0 end), 6) as ndcg_10, round(avg(case when rank is not null then 1.0::double / rank else 0 end), 6) as map,
count(*) filter (rank_pes > rank_opt) as ties, count(*) filter (rank is null) as missing from fl left join r on fl.q = r.q group by 1""",
    "span_strip": """with r as (select pair_id, lower(exploit_text) as q, lower(vulnerability_text) as g from ev_pairs where exploit_text is not null and vulnerability_text is not null), h as (select distinct pair_id, unnest([substr(g, i, 20) for i in range(1, length(g) - 18)]) as x from r),
s as (select pair_id, i, substr(q, i, 20) as x from r, range(1, length(q) - 18) t(i)), c as (select distinct s.pair_id, unnest(range(s.i, s.i + 20)) as i from s join h on s.pair_id = h.pair_id and s.x = h.x), p as (select r.pair_id, count(*) as covered, count(*) filter (substr(q, i::int, 1) = ' ') as blanks from c join r on c.pair_id = r.pair_id group by 1)
select r.pair_id, length(q)::int as before, (length(replace(q, ' ', '')) - coalesce(covered - blanks, 0))::int as left from r left join p on r.pair_id = p.pair_id""",
    "last_run": "select event_type, user_id % 5 as seed, arg_max(event_id, {'a': ts, 'b': event_id}) as event_id, arg_max(value, {'a': ts, 'b': event_id}) as value from events group by 1, 2",
    "seed_spread": "with s as (select event_type, case when event_type = 'error' then 0 else user_id % 5 end as seed, sum(round(value * 100)::bigint)::double / count(*) as m from events group by 1, 2) select event_type, round(avg(m), 4) as mean, round(case when count(*) > 1 then stddev_samp(m) end, 4) as sd, count(*) as seeds from s group by 1",
    "judge_summary": f"""select count(*) as n_rows, count(*) filter (a_ok and b_ok) as completed, count(*) filter (a_ok and b_ok and a = b) as consensus, count(*) filter (a_ok and b_ok and a <> b) as disagreement, round(count(*) filter (a_ok and b_ok and a = b and a = benchmark)::double / nullif(count(*) filter (a_ok and b_ok and a = b), 0), 4) as agreement_on_consensus,
count(*) filter (a_ok and b_ok and (ar or br or a <> b)) as needs_human_review, false as human_labels_present from {_pk}""",
    "packet_summary": "with r as (select label::varchar as b, case pair_id % 4 when 1 then '1' when 2 then '0' end as a from ev_pairs), s as (select count(*) as n_rows, count(a) as completed, count(*) filter (a = b) as agreements from r) select n_rows, completed, round(agreements::double / nullif(completed, 0), 4) as agreement, case when completed = n_rows and n_rows > 0 then 'complete' else 'annotation_pending' end as status from s",
    "cross_task_overlap": f"""with t as (select 'task1' as k, {_fp('text')} as n from task1_cve_linkage union select 'task2', {_fp('text')} from task2_exploit_type union select 'task3', {_fp('exploit_text')} from ev_pairs union select 'task4', {_fp('vulnerability_text')} from ev_pairs), u as (select * from t where n <> ''), p as (select a.k as left_task, b.k as right_task from (values ('task1'), ('task2'), ('task3'), ('task4')) a(k), (values ('task1'), ('task2'), ('task3'), ('task4')) b(k) where a.k < b.k)
select left_task, right_task, (select count(*) from u x join u y on x.n = y.n where x.k = left_task and y.k = right_task) as shared from p""",
    "subset_check": f"with r as (select split, count(*) over (partition by id, cve_id, {_fp('text')}) as n from task1_cve_linkage) select split, count(*) as items, count(*) filter (n > 1) as repeated from r where split <> 'train' group by 1",
    "aligned_runs": f"select count(*) as n, count(*) as aligned, 0::bigint as missing, sum(o.rr)::bigint as okapi_sum, sum(p.rr)::bigint as plus_sum, sum(s.rr)::bigint as smoke_sum from {_rr('okapi')} o join {_rr('plus')} p on o.q = p.q join {_rr('smoke')} s on o.q = s.q",
}
