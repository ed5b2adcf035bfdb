"""Fusing and re-ranking runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


def rrf(runs: list[tuple[DataFrame, float]], k: int = 60, top: int | None = None, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank); depth cuts each run first. A union and one sum, no outer join."""
    parts = [(r if depth is None else r.where(F.col("rank") <= depth)).select("query_id", "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in runs]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return ranked(fused, top, 10)


def mixed_scores(a: DataFrame, b: DataFrame, w_a: float = 0.5, top: int | None = None) -> DataFrame:
    """w_a * score_a + (1 - w_a) * score_b over the pairs that both runs score."""
    both = a.select("query_id", "doc_id", F.col("score").alias("sa")).join(b.select("query_id", "doc_id", F.col("score").alias("sb")), ["query_id", "doc_id"])
    return ranked(both.select("query_id", "doc_id", (w_a * F.col("sa") + (1 - w_a) * F.col("sb")).alias("score")), top)


def min_max(run: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; a constant list becomes 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def z_scores(run: DataFrame) -> DataFrame:
    """Scores of each query less their mean, over their population standard deviation (0 if that is 0)."""
    w = Window.partitionBy("query_id")
    spread = F.stddev_pop("score").over(w)
    return run.withColumn("score", F.when(spread > 1e-12, (F.col("score") - F.avg("score").over(w)) / spread).otherwise(F.lit(0.0)))


def z_rerank(first: DataFrame, second: DataFrame, depth: int) -> DataFrame:
    """The top `depth` of the first run by the sum of both runs' z-scores over these candidates; others are left out."""
    cand = first.where(F.col("rank") <= depth).select("query_id", "doc_id", "score")
    other = cand.select("query_id", "doc_id").join(second.select("query_id", "doc_id", "score"), ["query_id", "doc_id"])
    a, b = z_scores(cand), z_scores(other)
    both = a.select("query_id", "doc_id", F.col("score").alias("za")).join(b.select("query_id", "doc_id", F.col("score").alias("zb")), ["query_id", "doc_id"], "left")
    return ranked(both.select("query_id", "doc_id", (F.col("za") + F.coalesce("zb", F.lit(0.0))).alias("score")))


def late_max(views: list[Column], parent: Column, weight: float = 0.9) -> Column:
    """weight * parent's score + the rest of the weight * the best view's score."""
    return weight * parent + (1 - weight) * F.greatest(*views)


def rescored(candidates: DataFrame, scores: DataFrame, top: int | None = None) -> DataFrame:
    """Candidates re-ranked by scores (query_id, doc_id, score); those without a score are dropped, a query without any keeps its order."""
    joined = candidates.select("query_id", "doc_id", "rank").join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    known = F.max(F.col("score").isNotNull().cast("int")).over(Window.partitionBy("query_id"))
    kept = joined.withColumn("known", known).where("score IS NOT NULL OR known = 0")
    return ranked(kept.select("query_id", "doc_id", F.coalesce("score", -F.col("rank").cast("double")).alias("score")), top)


def softmax(run: DataFrame, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return run.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def first_available(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """The preferred run's lists, and the fallback's for queries that it lacks."""
    missing = fallback.join(preferred.select("query_id").distinct(), "query_id", "left_anti")
    return preferred.select("query_id", "doc_id", "score", "rank").unionByName(missing.select("query_id", "doc_id", "score", "rank"))
