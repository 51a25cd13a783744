"""Searches that ask with every item: the tables here hold no item whose id is divisible by 20, or one of many."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctilake.operators import metrics as M
from ctilake.operators import retrieval as R
from ctilake.plans import evaluation, retrieval

WORDS = "alpha beta gamma delta eps zeta eta theta iota".split()
K1 = {"okapi": 1.5, "plus": 1.5, "smoke": 1.2}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Folder of small tables with items 1 to 45, of which 20 and 40 alone are divisible by 20."""
    at = str(tmp_path_factory.mktemp("small"))
    text = lambda k, n: " ".join(WORDS[(k * j + k // 3) % 9] for j in range(1, n))
    items = [(k, text(k, 2 + k % 5), f"CVE-{2020 + k % 3}-{k}", "a") for k in range(1, 46)] + [(50, None, None, "a"), (51, "unheard", "CVE-2020-1", "a")]
    pairs = [(k, text(k * 7, 2 + k % 7), f"CVE-{2020 + k % 4}-{k}") for k in range(60)] + [(70, None, None)]
    spark.createDataFrame(items, "item_id bigint, text string, cve_id string, source string").write.parquet(f"{at}/task1_cve_linkage.parquet")
    spark.createDataFrame(pairs, "pair_id bigint, vulnerability_text string, cve_id string").write.parquet(f"{at}/ev_pairs.parquet")
    vectors = [(k, np.random.default_rng(k).normal(size=4).tolist()) for k in range(11)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return at


def _joined(spark, at, variant):
    posts = lambda t, key, text: R.postings(spark.read.parquet(f"{at}/{t}.parquet"), key, F.coalesce(text, F.lit("")))
    return R.bm25(posts("task1_cve_linkage", "item_id", "text"), posts("ev_pairs", "pair_id", "vulnerability_text"), variant, K1[variant])


def _rows(df):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("variant", ["okapi", "plus", "smoke"])
def test_every_item_is_asked_for_its_best_ten(spark, small, variant):
    got = retrieval.QUERIES[f"bm25_{variant}_topk"](spark, small)
    assert {r["q"] for r in got.select("q").distinct().collect()} == set(range(1, 46))
    assert _rows(got) == _rows(R.top_k(_joined(spark, small, variant), 10))
    assert "% 20" not in retrieval.SQL[f"bm25_{variant}_topk"]


def test_every_item_is_asked_for_its_best_mixtures(spark, small):
    unit = [(x := np.random.default_rng(k).normal(size=4)) / np.linalg.norm(x) for k in range(11)]
    scores = _joined(spark, small, "okapi").toPandas()
    best = scores.groupby("q")["score"].max()
    scores["score"] = [round(0.7 * (round(float(unit[q % 11] @ unit[d % 11]), 6) + 1) / 2 + 0.3 * (s / best[q] if best[q] > 0 else s), 6) for q, d, s in scores[["q", "d", "score"]].itertuples(index=False)]
    got = evaluation.hybrid_full(spark, small)
    assert {r["q"] for r in got.select("q").distinct().collect()} == set(range(1, 46))
    assert _rows(got) == _rows(R.top_k(spark.createDataFrame(scores), 10))
    assert "% 20" not in evaluation.SQL["hybrid_full"]


def test_mixtures_round_halves_away_from_zero():
    halves = np.array([0.5, 1.5, 2.5, -0.5, -2.5, 0.4, -0.6]) / 1e6
    assert (R._half_up(halves) * 1e6).round(6).tolist() == [1, 2, 3, -1, -3, 0, -1]


def test_every_item_enters_the_paired_mean(spark, small):
    year = lambda t, key, name: spark.read.parquet(f"{small}/{t}.parquet").select(F.col(key).alias(name), F.substring("cve_id", 5, 4).alias("y"))
    gold = year("task1_cve_linkage", "item_id", "q").join(year("ev_pairs", "pair_id", "d"), "y").select("q", "d")
    rr = {v: {r["q"]: 1_000_000 // r["rank"] if r["rank"] <= 10 else 0 for r in R.gold_ranks(_joined(spark, small, v), gold).collect()} for v in ("plus", "okapi")}
    wanted = sum(rr["plus"].get(q, 0) - rr["okapi"].get(q, 0) for q in [*range(1, 46), 50, 51]) / 47
    got = evaluation.paired_bootstrap(spark, small).first()
    assert got["mean"] == round(wanted, 4) != 0 and got["low"] <= got["mean"] <= got["high"]
    assert "% 20" not in evaluation.SQL["paired_bootstrap"] and "% 20" in evaluation.SQL["aligned_runs"]


def test_draws_hashed_together_are_those_of_md5():
    for prefix, n in (("plus - okapi", 10_050), ("é|y", 9), ("x" * 47, 120), ("x" * 60, 12), ("a", 1)):
        for rep in (0, 9_999, -1):
            wanted = [int(hashlib.md5(f"{prefix}|{rep}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(1, n + 1)]
            assert M._draws(prefix, n, rep, M._places(n)).tolist() == wanted
