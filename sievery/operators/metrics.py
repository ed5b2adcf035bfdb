"""Ranking metrics over judged runs: (query_id, doc_id, rank, grade), with a table of relevant counts where a metric needs it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grades of qrels (query_id, doc_id, grade), 0 where unjudged; queries without any qrels are left out."""
    known = run.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return known.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def gain_sum(k: int, gain: Column, rank: Column) -> Column:
    return F.sum(F.when(rank <= k, gain * discount(rank)).otherwise(F.lit(0.0)))


def ndcg(run: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: linear gain; the ideal is the best order of the retrieved list alone; 0 without a positive grade."""
    if k <= 0:
        raise ValueError("k must be positive")
    ideal = run.withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    sums = ideal.groupBy("query_id").agg(gain_sum(k, F.col("grade"), F.col("rank")).alias("dcg"), gain_sum(k, F.col("grade"), F.col("best")).alias("idcg"))
    return sums.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def ndcg_binary_fixed(run: DataFrame, k: int = 5) -> DataFrame:
    """Hits' discounts over those of k hits, however many there are."""
    full = sum(1 / math.log2(i + 1) for i in range(1, k + 1))
    return run.groupBy("query_id").agg((gain_sum(k, (F.col("grade") > 0).cast("double"), F.col("rank")) / full).alias("ndcg"))


def ndcg_exponential(run: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Gain 2^grade - 1; the ideal has min(k, relevant) hits of grade 1 (relevant: query_id, n_rel)."""
    got = run.groupBy("query_id").agg(gain_sum(k, F.pow(F.lit(2.0), F.col("grade")) - 1, F.col("rank")).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = got.join(relevant, "query_id").withColumn("idcg", F.when(F.col("n_rel") > 0, ideal).otherwise(F.lit(0.0)))
    return both.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def hit_metrics(run: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id, mrr, and recall_k, precision_k, hit_k for each k: recall over all relevant, precision over k; one aggregation."""
    hit = F.col("grade") > 0
    sums = [F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    sums += [F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"n_{k}") for k in ks]
    out = run.groupBy("query_id").agg(*sums).join(relevant, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    columns = [F.col("query_id"), F.col("mrr")]
    for k in ks:
        n = F.col(f"n_{k}")
        columns += [F.when(F.col("n_rel") > 0, n / F.col("n_rel")).otherwise(F.lit(0.0)).alias(f"recall_{k}"), (n / k).alias(f"precision_{k}"), (n > 0).cast("int").alias(f"hit_{k}")]
    return out.select(*columns)


def average_precision(run: DataFrame, relevant: DataFrame, cutoff: int | None = None, denominator: str = "all") -> DataFrame:
    """query_id, ap: precision at each hit up to the cutoff, over all relevant ("all") or min(relevant, cutoff) ("min_k")."""
    if denominator not in ("all", "min_k") or (denominator == "min_k" and cutoff is None):
        raise ValueError("denominator is all, or min_k with a cutoff")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    some = run if cutoff is None else run.where(F.col("rank") <= cutoff)
    hits = some.withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(w))
    sums = hits.groupBy("query_id").agg(F.sum(F.when(F.col("grade") > 0, F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))).alias("s"))
    n = F.col("n_rel") if denominator == "all" else F.least(F.col("n_rel"), F.lit(cutoff))
    return sums.join(relevant, "query_id", "left").select("query_id", F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.col("s") / n).otherwise(F.lit(0.0)).alias("ap"))


def rank_of_own(scores: DataFrame) -> DataFrame:
    """scores (query_id, doc_id, score) with the own pair query_id = doc_id: rank is 1 + how many score strictly more."""
    own = F.max(F.when(F.col("query_id") == F.col("doc_id"), F.col("score"))).over(Window.partitionBy("query_id"))
    return scores.withColumn("own", own).groupBy("query_id").agg((1 + F.sum(F.when(F.col("score") > F.col("own"), 1).otherwise(0))).alias("rank"))


def first_hit(run: DataFrame, depth: int = 100) -> DataFrame:
    """query_id and the rank of the best relevant document, depth + 1 where none is within the depth."""
    return run.groupBy("query_id").agg(F.coalesce(F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= depth), F.col("rank"))), F.lit(depth + 1)).alias("first_rank"))


def macro(per_query: DataFrame, columns: list[str]) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n_queries"))


def weighted_overall(per_set: DataFrame, metric: str, size: str) -> DataFrame:
    return per_set.agg((F.sum(F.col(metric) * F.col(size)) / F.sum(size)).alias("overall"))
