"""Near-duplicate queries over the exploit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.operators import neardup as D
from ctilake.sources.tables import cut, table


def jaccard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar classes of exploit records: representatives and their similarity."""
    edges = D.jaccard_edges(table(spark, sf_dir, "task2_exploit_type"), "rec_id", "text")
    return edges.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every record and the number of other classes it is similar to."""
    records = table(spark, sf_dir, "task2_exploit_type")
    edges = D.jaccard_edges(records, "rec_id", "text")
    ends = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return D.classes(records, "rec_id", "text").join(ends, "class_id", "left").select(F.col("key").alias("rec_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def near_dup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives that a greedy pass in key order keeps."""
    records = table(spark, sf_dir, "task2_exploit_type")
    nodes = cut(D.classes(records, "rec_id", "text").select(F.col("class_id").alias("key")).distinct())
    return D.greedy_kept(nodes, D.jaccard_edges(records, "rec_id", "text")).select(F.col("key").alias("rec_id"), "kept")


def simhash_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of exploit records whose SimHashes differ in at most three bits."""
    return D.simhash_edges(table(spark, sf_dir, "task2_exploit_type"), "rec_id", "text")


QUERIES = {f.__name__: f for f in (jaccard_edges, near_dup_classes, near_dup_kept, simhash_edges)}
_edges = r"""w as (select rec_id, list_aggregate(regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f\v]+'), 'string_agg', ' ') as w from task2_exploit_type), m as (select rec_id, min(rec_id) over (partition by w) as class_id, w from w where w <> ''),
l as (select rec_id as k, string_split(w, ' ') as l from m where rec_id = class_id), s as (select distinct k, unnest(case when len(l) >= 5 then [list_aggregate(l[i:i + 4], 'string_agg', ' ') for i in range(1, len(l) - 3)] else [list_aggregate(l, 'string_agg', ' ')] end) as s from l),
n as (select k, count(*) as n from s group by 1), i as (select x.k as a, y.k as b, count(*) as i from s x join s y on x.s = y.s and x.k < y.k group by 1, 2), e as (select a, b, i::double / (x.n + y.n - i) as j from i join n x on a = x.k join n y on b = y.k where i::double / (x.n + y.n - i) >= 0.8 - 1e-9)"""
SQL = {
    "jaccard_edges": f"with {_edges} select a, b, round(j, 6) as jaccard from e",
    "near_dup_classes": f"with {_edges}, k as (select k as c, count(*) as links from (select a as k from e union all select b from e) group by 1) select rec_id, class_id, coalesce(links, 0) as links from m left join k on class_id = c",
}
