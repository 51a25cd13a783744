"""Same and near-same records across splits: problem 2.

Exact copies are found by hashing canonical records and joining evaluation hashes with training
hashes. Near copies (sets of three-character substrings that share at least 0.8 of their union)
have different hashes, so the same join runs on banded MinHash keys and every candidate is
verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.sources.tables import broadcast_if_small, cut, table

SIMILARITY = 0.8
BANDS, ROWS = 48, 7
LEAST_BANDS = 2  # that a candidate shares; a pair at 0.8 shares 10 on average and fewer than two with probability 2e-4, one at 0.85 with 2e-7
BLOCK = 84  # hash functions taken at once, so that their values stay in the cache
_SEED = np.random.default_rng(20260101)
_A, _B = _SEED.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * 2 + 1, _SEED.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def normal(text: Column) -> Column:
    """Lower case, each run of white space as one blank."""
    blank = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
    return F.regexp_replace(F.lower(text), rf"[{blank}&&[^ ]][{blank}]*| [{blank}]+", " ")  # a single blank stays and costs no replacement


def canonical(text: Column) -> Column:
    """Letters and digits in lower case: without punctuation and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signature(text: str) -> np.ndarray:
    """MinHash of the three-character substrings; of the text itself where it is shorter."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) if len(c) > 2 else np.array([hash(tuple(c.tolist())) & (2**63 - 1)], np.uint64)
    x = _mix(np.unique(grams)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for part in np.array_split(x, -(-len(x) // 4096)):
        h = np.empty((BLOCK, len(part)), np.uint32)
        for i in range(0, len(_A), BLOCK):
            np.bitwise_xor(part[None, :], _B[i : i + BLOCK, None], out=h)
            np.multiply(h, _A[i : i + BLOCK, None], out=h)
            np.minimum(out[i : i + BLOCK], h.min(1), out=out[i : i + BLOCK])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(ROWS)], np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            s = np.stack([signature(t) for t in batch.column(1).slice(at, 1000).to_pylist()])
            # the band's number is mixed in, so a key stands for a band and its values
            keys = _mix(s.reshape(len(s), BANDS, ROWS).astype(np.uint64) @ weights + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).slice(at, 1000).to_numpy(), BANDS)), pa.array(keys.view(np.int64).ravel())], ["text_class", "h"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def grams(t: str) -> set[str]:
        return {t[i : i + 3] for i in range(len(t) - 2)}

    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        keep, memo = [], {}
        for x, y in zip(a, b):
            if x not in memo:
                memo.clear()
                memo[x] = grams(x)
            g, h = memo[x], grams(y)
            common = len(g & h)
            keep.append(bool(g or h) and common >= SIMILARITY * (len(g) + len(h) - common) - 1e-9)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def links(evaluation: DataFrame, training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From two tables (id, text): (members (side, id, text_class), pairs (class_e, class_t)).

    Texts that are the same after normalisation are one class, found by aggregation on the map
    side; classes and not rows are compared, so copies cost nothing. Texts are signed where they are
    grouped and only band keys are shuffled. Classes that share at least LEAST_BANDS keys are
    candidates: chance pairs share none or one, so no text moves for them. The rest are verified on
    whole texts. Members are given for the classes of candidates only. Blank and null texts take no part.
    """
    side = lambda df, n: df.select(F.lit(n).alias("side"), "id", F.explode(F.array(normal(F.col("text")))).alias("text"))  # noqa: E731  a generator, so that no filter is pushed below it and reads the text twice
    rows = side(evaluation, 0).unionByName(side(training, 1)).filter("text not in ('', ' ')").withColumn("text_class", F.xxhash64(F.xxhash64("text"), F.xxhash64(F.lit(5), "text")))
    classes = rows.groupBy("text_class").agg(F.first("text").alias("text"), F.bit_or(F.col("side") + 1).alias("sides"))  # 1 evaluation, 2 training: one column, so both sides read one exchange
    signed = lambda name, bit: classes.filter(F.col("sides").bitwiseAND(F.lit(bit)) > 0).select("text_class", "text").mapInArrow(_sign, "text_class bigint, h bigint").withColumnRenamed("text_class", f"class_{name}")
    shared = signed("e", 1).join(signed("t", 2), "h").groupBy("class_e", "class_t").agg(F.count(F.lit(1)).alias("n"))
    candidates = cut(shared.filter(F.col("n") >= LEAST_BANDS).select("class_e", "class_t"))  # a text on both sides shares all keys with itself
    wanted = candidates.select(F.col("class_e").alias("text_class")).union(candidates.select("class_t")).distinct()
    held = cut(rows.join(broadcast_if_small(wanted), "text_class", "left_semi"))
    texts = held.groupBy("text_class").agg(F.first("text").alias("text"))
    text = lambda name: texts.select(F.col("text_class").alias(f"class_{name}"), F.col("text").alias(f"text_{name}"))
    verified = candidates.filter("class_e <> class_t").join(text("t"), "class_t").join(text("e"), "class_e").select("class_e", "class_t", "text_e", "text_t").mapInArrow(_verify, "class_e bigint, class_t bigint")
    return held.select("side", "id", "text_class"), cut(verified.unionByName(candidates.filter("class_e = class_t")))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "task2_exploit_type")
    evaluation = records.filter(F.col("_split").isin("val", "test")).select(F.col("rec_id").alias("id"), "text")
    training = records.filter(F.col("_split") == "train").select(F.col("rec_id").alias("id"), "text")
    return evaluation, training.unionByName(table(spark, sf_dir, "ev_pairs").select(F.col("pair_id").alias("id"), F.col("exploit_text").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out and training records of the same or nearly the same text: (id_a, id_b), smaller key first."""
    members, pairs = links(*_sides(spark, sf_dir))
    e = members.filter("side = 0").select(F.col("id").alias("e"), F.col("text_class").alias("class_e"))
    t = members.filter("side = 1").select(F.col("id").alias("t"), F.col("text_class").alias("class_t"))
    pairs = broadcast_if_small(pairs)
    found = e.join(pairs, "class_e").join(t, "class_t")
    return found.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def p2_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records, those with a training copy, and copies, by split and source.

    Copies are counted per text class before the join, so no group of copies is expanded.
    """
    members, pairs = links(*_sides(spark, sf_dir))
    weight = members.filter("side = 1").groupBy(F.col("text_class").alias("class_t")).agg(F.count(F.lit(1)).alias("n"))
    per_class = pairs.join(weight, "class_t").groupBy("class_e").agg(F.sum("n").alias("copies"))
    records = table(spark, sf_dir, "task2_exploit_type").filter(F.col("_split").isin("val", "test")).select(F.col("rec_id").alias("id"), F.col("_split").alias("split"), "source")
    matched = members.filter("side = 0").join(per_class, members["text_class"] == per_class["class_e"]).select("id", "copies")
    out = records.join(matched, "id", "left").groupBy("split", "source")
    return out.agg(F.count(F.lit(1)).alias("records"), F.count("copies").alias("overlapping"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))


def p2_exact_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out records whose canonical hash a training record has, by split and source."""
    evaluation, training = _sides(spark, sf_dir)
    key = lambda df: df.select("id", canonical(F.col("text")).alias("_c")).filter("_c <> ''").select("id", F.sha2("_c", 256).alias("fp"))
    known = key(training).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    per_text = key(evaluation).join(known, "fp").select("id", "n")
    records = table(spark, sf_dir, "task2_exploit_type").filter(F.col("_split").isin("val", "test")).select(F.col("rec_id").alias("id"), F.col("_split").alias("split"), "source")
    out = records.join(per_text, "id", "left").groupBy("split", "source")
    return out.agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))


QUERIES = {"p2_found": p2_found, "p2_by_split_and_source": p2_by_split_and_source, "p2_exact_by_split_and_source": p2_exact_by_split_and_source}
SQL = {
    "p2_found": r"""
with r as (select rec_id as id, _split <> 'train' as e, regexp_replace(lower(text), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g') as t from task2_exploit_type union all select pair_id, false, regexp_replace(lower(exploit_text), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g') from ev_pairs),
k as (select id, e, t from r where trim(t) <> ''), g as (select distinct id, e, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) as g from k), n as (select id, count(*) as n from g group by 1),
i as (select x.id as a, y.id as b, count(*) as i from g x join g y on x.g = y.g and x.e and not y.e group by 1, 2)
select least(a, b) as id_a, greatest(a, b) as id_b from i join n x on a = x.id join n y on b = y.id where 5 * i >= 4 * (x.n + y.n - i)
union select least(x.id, y.id), greatest(x.id, y.id) from k x join k y on x.t = y.t and x.e and not y.e""",
    "p2_by_split_and_source": r"""
with r as (select rec_id as id, _split <> 'train' as e, regexp_replace(lower(text), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g') as t from task2_exploit_type union all select pair_id, false, regexp_replace(lower(exploit_text), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g') from ev_pairs),
k as (select id, e, t from r where trim(t) <> ''), g as (select distinct id, e, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) as g from k), n as (select id, count(*) as n from g group by 1),
i as (select x.id as a, y.id as b, count(*) as i from g x join g y on x.g = y.g and x.e and not y.e group by 1, 2),
m as (select a, b from i join n x on a = x.id join n y on b = y.id where 5 * i >= 4 * (x.n + y.n - i) union select x.id, y.id from k x join k y on x.t = y.t and x.e and not y.e),
c as (select a, count(*) as n from m group by 1)
select _split as split, source, count(*) as records, count(n) as overlapping, coalesce(sum(n), 0)::bigint as copies from task2_exploit_type left join c on rec_id = a where _split <> 'train' group by 1, 2""",
    "p2_exact_by_split_and_source": r"""
with c as (select rec_id as id, _split as split, source, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as c from task2_exploit_type),
t as (select c from c where split = 'train' and c <> '' union all select regexp_replace(lower(exploit_text), '[^\p{L}\p{N}]+', '', 'g') from ev_pairs),
k as (select c, count(*) as n from t where c <> '' group by c)
select split, source, count(*) as records, count(n) as overlapping, coalesce(sum(n), 0)::bigint as copies
from (select * from c where split in ('val', 'test')) e left join k on e.c = k.c group by split, source""",
}
