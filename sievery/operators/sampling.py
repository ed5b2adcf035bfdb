"""Samples, quotas, splits, hard negatives and triplets: seeded by MD5, so the same in any engine and at each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievery.functions.text import hashed_unit

from .places import binned, numbered


def per_group(rows: DataFrame, by: list[str], n: Column | int, order: list[Column | str]) -> DataFrame:
    """The first n rows of each group; Spark cuts the groups before its shuffle where n is a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def shuffled(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def first_of_key(rows: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    return per_group(rows.withColumn("_key", key), ["_key"], 1, order).drop("_key")


def split_by_text(rows: DataFrame, text: Column, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """rows with split: decided by the MD5 of the normalised text alone, so equal texts share a split and no shuffle is needed."""
    u = hashed_unit(text)
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def share_sample(rows: DataFrame, by: str, shares: dict[str, float], total: int, seed: int, key: str) -> DataFrame:
    """Up to share * total rows of each group that has a share."""
    want = F.coalesce(*[F.when(F.col(by) == g, F.lit(int(s * total))) for g, s in shares.items()], F.lit(0))
    return per_group(rows.withColumn("_want", want), [by], F.col("_want"), shuffled(seed, key)).drop("_want")


def proportional_sample(rows: DataFrame, by: str, total: int, floor: int, seed: int, key: str) -> DataFrame:
    """max(floor, total * the group's share) rows of each group; bins are the first digits of the MD5 that orders them."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    want = sizes.withColumn("_want", F.greatest(F.lit(floor), F.floor(F.lit(total) * F.col("_n") / F.sum("_n").over(Window.partitionBy()))))
    order = shuffled(seed, key)
    placed = numbered(rows.withColumn("_bin", F.substring(order[0], 1, 3)), [by], order)
    return placed.join(F.broadcast(want.select(by, "_want")), by).where("_nth <= _want").drop("_nth", "_want")


def running_quota(rows: DataFrame, by: str, order: str, quota: int) -> DataFrame:
    """The rows of each stratum until it is full, in order of arrival."""
    return per_group(rows, [by], quota, [order])


def soft_quota(rows: DataFrame, by: str, order: str, cap: int, seed: int) -> DataFrame:
    """All rows up to the cap; after it, the n-th is kept with probability 1 / sqrt(n / cap). The order is a numeric column."""
    keep = (F.col("_nth") <= cap) | (hashed_unit(str(seed), F.col(order)) < 1 / F.sqrt(F.col("_nth") / F.lit(cap)))
    return numbered(binned(rows, order), [by], [order]).where(keep).drop("_nth")


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 10, "top").when(rank <= 40, "mid").when(rank <= 100, "tail").otherwise("none")


def gaussian_weight(score: Column, peak: float = 0.75, sigma: float = 0.10) -> Column:
    return F.exp(-F.pow((score - peak) / sigma, 2))


def hard_negatives(candidates: DataFrame, k: int, factor: float, peak: float, sigma: float, seed: int) -> DataFrame:
    """candidates (query_id, doc_id, score, rank, grade): non-relevant ones not above factor * the best relevant score,
    k a query by weighted sampling without replacement (least -ln(u) / w) with Gaussian weights around the peak."""
    best = F.max(F.when(F.col("grade") > 0, F.col("score"))).over(Window.partitionBy("query_id"))
    rows = candidates.withColumn("best", best).where((F.col("grade") <= 0) & (F.col("best").isNull() | (F.col("score") <= factor * F.col("best"))))
    w = F.greatest(gaussian_weight(F.col("score"), peak, sigma), F.lit(1e-12))
    u = hashed_unit(str(seed), F.col("query_id"), F.col("doc_id"))
    keyed = rows.withColumn("weight", w).withColumn("key", F.round(F.ln(F.greatest(u, F.lit(1e-12))) / F.col("weight"), 6))
    return per_group(keyed, ["query_id"], k, [F.desc("key"), F.col("doc_id")]).drop("best")


def ranking_errors(run: DataFrame, depth: int = 20, negatives: int = 3, positives: int = 2) -> DataFrame:
    """Triplets (query_id, positive, negative): relevant documents with a non-relevant one ranked above, capped on both sides.

    The caps come before the join, so a query contributes at most negatives * positives pairs."""
    top = run.where(F.col("rank") <= depth)
    bad = per_group(top.where("grade <= 0"), ["query_id"], negatives, ["rank"]).select("query_id", F.col("doc_id").alias("negative"), F.col("rank").alias("rn"))
    good = per_group(top.where("grade > 0"), ["query_id"], positives, [F.desc("rank")]).select("query_id", F.col("doc_id").alias("positive"), F.col("rank").alias("rp"))
    return good.join(bad, "query_id").where("rn < rp").select("query_id", "positive", "negative")


def margin_pairs(run: DataFrame, margin: float, depth: int) -> DataFrame:
    """Ordered pairs of a query's top `depth` whose scores differ by more than the margin: depth squared pairs a query at most."""
    top = run.where(F.col("rank") <= depth).select("query_id", "doc_id", "score")
    b = top.select("query_id", F.col("doc_id").alias("doc_j"), F.col("score").alias("score_j"))
    pairs = top.join(b, "query_id").withColumn("margin", F.round(F.col("score") - F.col("score_j"), 6)).where(F.col("margin") > margin)
    return pairs.select("query_id", F.col("doc_id").alias("doc_i"), "doc_j", "margin")


def same_group_pairs(rows: DataFrame, key: str, group: str, most: int, seed: int) -> DataFrame:
    """For each row up to `most` others of its group: the next ones in the group's shuffled order, from the start again at its end.

    Neighbours by place instead of all pairs: each row joins `most` places."""
    w = Window.partitionBy(group).orderBy(*shuffled(seed, key))
    placed = rows.select(key, group).withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    want = placed.select(F.col(key).alias("query_id"), group, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("_step"), "_p", "_n").where("_step < _n")
    want = want.withColumn("_p", F.pmod(F.col("_p") + F.col("_step"), F.col("_n"))).drop("_n")
    return want.join(placed.select(F.col(key).alias("doc_id"), group, "_p"), [group, "_p"]).select("query_id", "doc_id", group)


def grouped_batches(rows: DataFrame, by: str, per_batch: int, key: str, seed: int) -> DataFrame:
    """Exactly per_batch rows for each group; small groups repeat theirs in turn."""
    ordered = rows.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(*shuffled(seed, key))) - 1)
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    slots = sizes.select(by, F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1))).alias("slot"), "_n").withColumn("_p", F.col("slot") % F.col("_n"))
    return slots.join(ordered.where(F.col("_p") < per_batch), [by, "_p"]).select(by, "slot", key)


def greedy_quota(rows: DataFrame, key: str, buckets: str, order: str, targets: dict[str, int]) -> DataFrame:
    """The rows a scan in `order` (unique) takes, with needed: a row is taken if its key was not taken before and any of its
    buckets (an array) has room; it then fills all of its buckets that have room.

    While a bucket has room, every key that comes up in it is taken or was taken before, and at most the sum of the
    targets are taken at all. So of each bucket only the first so many keys, each at its first row, can matter: these, at
    most buckets times that sum, pass through one task as ids and bucket names; everything before is cut in the tasks."""
    total, named = sum(targets.values()), F.array(*map(F.lit, sorted(targets)))
    each = rows.select(F.col(key).cast("string").alias("_id"), F.col(order).alias("_at"), F.explode(F.array_intersect(buckets, named)).alias("_b"))
    able = per_group(each.groupBy("_id", "_b").agg(F.min("_at").alias("_at")), ["_b"], total, ["_at", "_id"])
    candidates = able.groupBy("_at", "_id").agg(F.collect_set("_b").alias("_b")).repartition(1).sortWithinPartitions("_at", "_id")

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, seen = dict(targets), set()
        for batch in batches:
            found = []
            for at, item, names in zip(batch["_at"], batch["_id"], batch["_b"], strict=True):
                needed = sorted(b for b in names if room[b] > 0)
                if needed and item not in seen:
                    seen.add(item)
                    found.append((at, item, needed))
                    for b in needed:
                        room[b] -= 1
            yield pd.DataFrame(found, columns=["_at", "_id", "needed"])

    kind = rows.schema[order].dataType.simpleString()
    chosen = candidates.mapInPandas(taken, f"_at {kind}, _id string, needed array<string>")
    same = (F.col(order) == F.col("_at")) & (F.col(key).cast("string") == F.col("_id"))
    return rows.join(F.broadcast(chosen) if total <= 100_000 else chosen, same).drop("_at", "_id")


def first_until(rows: DataFrame, keep: Column, order: str, target: int, most: int) -> DataFrame:
    """The kept rows, with nth, of a scan in a numeric order that stops at `target` kept rows or `most` examined ones."""
    examined = numbered(binned(rows, order), [], [order]).where(F.col("_nth") <= most).drop("_nth")
    return numbered(binned(examined.where(keep), order), [], [order]).where(F.col("_nth") <= target).withColumnRenamed("_nth", "nth")


def first_of_each(rows: DataFrame, by: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each group that has a quota, as many as that, with nth; Spark cuts the groups before its shuffle."""
    want = F.coalesce(*[F.when(F.col(by) == g, F.lit(n)) for g, n in quotas.items()])
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.where(F.col(by).isin(list(quotas))).withColumn("nth", nth).where(F.col("nth") <= max(quotas.values())).where(F.col("nth") <= want)


def top_share_weights(rows: DataFrame, batch: str, score: str, quantile: float = 0.9, weight: float = 5.0) -> DataFrame:
    """rows with weight: `weight` from the batch's interpolated quantile of the score on, else 1. A batch is of bounded size."""
    cuts = rows.groupBy(batch).agg(F.percentile(score, F.lit(quantile)).alias("_cut"))
    return rows.join(cuts, batch).withColumn("weight", F.when(F.col(score) >= F.col("_cut"), weight).otherwise(1.0)).drop("_cut")
