"""Ranking, classification and agreement metrics as aggregations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions.common import n_rows

_ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ir_metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Recall@1, 5, 10, MRR@10, nDCG@10, MAP, ties and missing ranks of (by, rank, rank_opt, rank_pes); a null rank counts as a miss."""
    r = F.col("rank")
    mean = lambda c: F.round(F.avg(c), 6)
    gain = lambda when, value: F.when(when, value).otherwise(0.0)
    return ranks.groupBy(*by).agg(
        n_rows().alias("n"), *[mean(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)], mean(gain(r <= 10, 1 / r)).alias("mrr_10"), mean(gain(r <= 10, 1 / F.log2(r + 1))).alias("ndcg_10"), mean(gain(r.isNotNull(), 1 / r)).alias("map"),
        F.count_if(F.col("rank_pes") > F.col("rank_opt")).alias("ties"), F.count_if(r.isNull()).alias("missing"),
    )


def _margins(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, tp, support, predicted) of every class on either side, from one count of label pairs."""
    c = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(n_rows().alias("n"))
    sides = c.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))).alias("s"))
    return sides.groupBy("s.class").agg(*[F.sum(f"s.{x}").alias(x) for x in ("tp", "support", "predicted")])


def class_f1(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of every class; an empty denominator gives 0."""
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("predicted")
    return _margins(rows, label, predicted).select("class", "tp", "support", "predicted", F.round(_ratio(tp, guessed), 6).alias("precision"), F.round(_ratio(tp, support), 6).alias("recall"), F.round(_ratio(2.0 * tp, support + guessed), 6).alias("f1"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Observed agreement, Cohen's kappa, Krippendorff's alpha for names, Gwet's AC1 and PABAK of two raters."""
    m = _margins(rows, a, b)
    total = m.agg(F.sum("support").alias("n"), F.sum("tp").alias("same"))
    half = (F.col("support") + F.col("predicted")) / 2.0 / F.col("n")
    s = m.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), F.max("same").alias("same"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("ab"), F.sum(half * (1 - half)).alias("g"), n_rows().alias("k"), F.sum((F.col("support") + F.col("predicted")).cast("double") * (F.col("support") + F.col("predicted") - 1)).alias("cc"))
    o, e, g, k = F.col("same") / F.col("n"), F.col("ab") / F.col("n") / F.col("n"), F.col("g") / (F.col("k") - 1), F.col("k")
    alike = F.try_divide("cc", 2.0 * F.col("n") * (2 * F.col("n") - 1))
    return s.select("n", F.round(o, 6).alias("observed"), F.round(F.try_divide(o - e, 1 - e), 6).alias("kappa"), F.round(1 - F.try_divide(1 - o, 1 - alike), 6).alias("alpha"), F.round(F.try_divide(o - g, 1 - g), 6).alias("ac1"), F.round(F.try_divide(k * o - 1, k - 1), 6).alias("pabak"))


def auc(rows: DataFrame, label: str, score: str, ranges: int = 64) -> DataFrame:
    """Area under the ROC curve with half credit for ties.

    Distinct scores are counted first and cut in ranges; a window runs within each, and what lies in
    the ranges below is carried over from their sums, so no task holds all scores.
    """
    c = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ends = c.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)])).first()[0] or []
    bucket = sum([(F.col("s") > e).cast("int") for e in sorted(set(ends))], F.lit(0))
    c = c.withColumn("bucket", bucket)
    sums = c.groupBy("bucket").agg(F.sum("n").alias("n"))  # at most one row a range
    carried = sums.select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    w = W.partitionBy("bucket").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    u = c.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(carried), "bucket").withColumn("below", F.col("inside") + F.col("carried"))
    return u.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"), F.round(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)), F.sum("p") * F.sum("n")), 6).alias("auc"))


_SHIFTS = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(1, 0), (5, 1), (3, 5), (7, 0)]  # the word of a step in each round


def _md5_heads(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """First four bytes of the MD5 of ``n`` messages of one block, read as a big-endian number; a word is an array or, where all have the same, a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    start, f, g = a.copy(), np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the first word of the digest is that of step 61
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        step, first = _TURN[i // 16]
        word = words[(step * i + first) % 16]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=g)
        f <<= np.uint32(_SHIFTS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (start + b).byteswap()


def _places(n: int) -> list[np.ndarray]:
    """The places from 1 to ``n`` as digits, a matrix of bytes for every number of digits and 8,192 places."""
    out, lo = [], 1
    while lo <= n:
        hi = min(n + 1, 10 ** len(str(lo)), lo + 8192)
        out.append(np.array([str(i).encode() for i in range(lo, hi)]).view(np.uint8).reshape(hi - lo, -1))
        lo = hi
    return out


def _draws(prefix: str, n: int, rep: int, places: list[np.ndarray]) -> np.ndarray:
    """Places, from 0 on, that a replicate draws: the first eight digits of the MD5 of prefix|replicate|place, modulo ``n``.

    Many are hashed at once, column by column of their digits; messages of more than one block go one by one.
    """
    head, out = f"{prefix}|{rep}|".encode(), []
    for digits in places:
        size = len(head) + digits.shape[1]
        if size > 55:
            out.append(np.frombuffer(b"".join([hashlib.md5(head + row.tobytes(), usedforsecurity=False).digest()[:4] for row in digits]), ">u4").astype(np.uint32))
            continue
        block = head + bytes(digits.shape[1]) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        words: list[np.ndarray | int] = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
        for at in range(digits.shape[1]):
            word, byte = divmod(len(head) + at, 4)
            words[word] = (digits[:, at].astype(np.uint32) << np.uint32(8 * byte)) + np.asarray(words[word], np.uint32)
        out.append(_md5_heads(words, len(digits)))
    return np.concatenate(out).astype(np.int64) % n


def _resampled(values: DataFrame, replicates: int, schema: str, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(grp, rep, ...) for every replicate of every row (grp, values): what ``of`` makes of the values and the places that it draws.

    A row holds the values of a group in order; replicates are spread over tasks in spans, so draws
    are made, used and dropped in one place and nothing of them is shuffled or joined.
    """
    tasks = max(1, min(replicates, 4 * values.sparkSession.sparkContext.defaultParallelism))
    spans = F.sequence(F.lit(0), F.lit(tasks - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, made = [], -1
        for batch in batches:
            for grp, held, span in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = np.asarray(held.values.fill_null(0))
                if made != len(x):
                    places, made = _places(len(x)), len(x)
                for rep in range(span, replicates, tasks):
                    columns = of(x, _draws(grp, len(x), rep, places))
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(columns[0])), pa.array(np.full(len(columns[0]), rep, np.int32)), *map(pa.array, columns)], ["grp", "rep", *[c.split()[0] for c in schema.split(", ")]])

    # one row a span, each in a partition of its own
    return values.select("grp", "values", F.explode(spans).alias("span")).repartition(tasks, "span").mapInArrow(run, f"grp string, rep int, {schema}")


def bootstrap_mean(rows: DataFrame, group: str, unit: str, value: str, replicates: int) -> DataFrame:
    """(grp, mean, low, high): mean of the units of every group and its 95 % interval by resampling units.

    Draws come from a hash of group, replicate and place, so every run, and every model compared on
    the same units, resamples alike.
    """
    k = rows.select(F.col(group).alias("grp"), F.col(unit).alias("u"), F.col(value).alias("v")).filter("grp is not null")
    values = k.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("m")).select("grp", F.col("m.v").alias("values"))
    means = _resampled(values, replicates, "m double", lambda x, at: [np.array([x[at].sum() / len(x)], float)])
    ends = means.groupBy("grp").agg(F.round(F.percentile("m", 0.025), 4).alias("low"), F.round(F.percentile("m", 0.975), 4).alias("high"))
    return k.groupBy("grp").agg(F.round(F.sum("v") / n_rows(), 4).alias("mean")).join(ends, "grp")


def f1_summary(rows: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1) from one count of label pairs; classes of either side count in the macro mean."""
    c = rows.groupBy(*by, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(n_rows().alias("_n"))
    zero = F.lit(0).cast("bigint")
    true = F.struct(F.col("_y").alias("_class"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("_tp"), F.col("_n").alias("_support"), zero.alias("_guessed"))
    guess = F.struct(F.col("_p").alias("_class"), zero.alias("_tp"), zero.alias("_support"), F.col("_n").alias("_guessed"))
    m = c.select(*by, F.explode(F.array(true, guess)).alias("_s")).groupBy(*by, "_s._class").agg(*[F.sum(f"_s.{x}").alias(x) for x in ("_tp", "_support", "_guessed")])
    m = m.withColumn("_f1", _ratio(2.0 * F.col("_tp"), F.col("_support") + F.col("_guessed")))
    whole = F.sum("_support")
    return m.groupBy(*by).agg(whole.alias("n"), F.round(_ratio(F.sum("_tp"), whole), 6).alias("accuracy"), F.round(F.avg("_f1"), 6).alias("macro_f1"), F.round(_ratio(F.sum(F.col("_f1") * F.col("_support")), whole), 6).alias("weighted_f1"))


def bootstrap_macro_f1(rows: DataFrame, key: str, label: str, predicted: str, replicates: int) -> DataFrame:
    """(n, macro_f1, low, high): macro F1 over the true classes and its 95 % interval by resampling records.

    Draws come from a hash of replicate and place. Every replicate draws as many records as there
    are, so this is for evaluation sets; the draws are counted to label pairs where they are made.
    """
    k = rows.select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(predicted).alias("p")).withColumn("code", F.xxhash64(F.to_json(F.struct("y", "p"))))
    values = k.groupBy(F.lit("f1").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("k", "code"))).alias("m")).select("grp", F.col("m.code").alias("values"))

    def counted(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return list(np.unique(x[at], return_counts=True))

    kinds = k.select("code", "y", "p").distinct()
    cells = _resampled(values, replicates, "code bigint, c bigint", counted).join(kinds, "code").select("rep", "y", "p", "c")
    every = cells.unionByName(k.groupBy(F.lit(-1).alias("rep"), "y", "p").agg(n_rows().alias("c")))
    classes = k.select("y").distinct().count()
    true = every.groupBy("rep", F.col("y").alias("class")).agg(F.sum("c").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    guessed = every.groupBy("rep", F.col("p").alias("class")).agg(F.sum("c").alias("guessed"))
    f1 = true.join(guessed, ["rep", "class"], "left").select("rep", (2.0 * F.col("tp") / (F.col("support") + F.coalesce("guessed", F.lit(0)))).alias("f1")).groupBy("rep").agg((F.sum("f1") / max(1, classes)).alias("m"))
    ends = f1.agg(F.round(F.max(F.when(F.col("rep") < 0, F.col("m"))), 6).alias("macro_f1"), F.round(F.percentile(F.when(F.col("rep") >= 0, F.col("m")), 0.025), 6).alias("low"), F.round(F.percentile(F.when(F.col("rep") >= 0, F.col("m")), 0.975), 6).alias("high"))
    return k.agg(n_rows().alias("n")).crossJoin(F.broadcast(ends))
