"""Building labelled pairs, triplets and evaluation sets from catalogs and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievery.functions.text import hashed_unit

from .sampling import per_group, shuffled


def benchmark(catalog: DataFrame, key: str, kind: str, group: str, queries: int, positives: int, negatives: int, least: int, seed: int) -> DataFrame:
    """(query_id, doc_id, grade): seeds of kinds with at least `least` members, up to `positives` of their kind (2) and `negatives` of their group but another kind (1).

    Seeds and members are cut for each kind and group before the joins, so a query meets at most the two limits and one more."""
    sizes = catalog.groupBy(kind).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    rows = catalog.select(key, kind, group).join(sizes.select(kind), kind, "left_semi")
    kinds = rows.select(kind).distinct().agg(F.count("*").alias("_kinds"))
    seeds = rows.join(F.broadcast(kinds)).withColumn("_want", F.greatest(F.lit(1), F.floor(F.lit(queries) / F.col("_kinds"))))
    seeds = per_group(seeds, [kind], F.col("_want"), shuffled(seed, key)).select(F.col(key).alias("query_id"), F.col(kind).alias("_kind"), F.col(group).alias("_group"))
    same = per_group(rows, [kind], positives + 1, shuffled(seed + 1, key)).select(F.col(key).alias("doc_id"), F.col(kind).alias("_kind"))
    pos = seeds.join(same, "_kind").where("query_id <> doc_id").select("query_id", "doc_id", F.lit(2).alias("grade"))
    other = per_group(rows, [group, kind], negatives, shuffled(seed + 2, key)).select(F.col(key).alias("doc_id"), F.col(kind).alias("_other"), F.col(group).alias("_group"))
    neg = seeds.join(other, "_group").where("_other <> _kind").select("query_id", "doc_id", F.lit(1).alias("grade"))
    cut = lambda d, n, s: per_group(d, ["query_id"], n, shuffled(s, "doc_id"))
    return cut(pos, positives, seed + 3).unionByName(cut(neg, negatives, seed + 4))


def candidate_union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, doc_id, source) of several sources: a pair keeps the first source that has it."""
    tagged = [d.select("query_id", "doc_id").withColumn("_order", F.lit(i)).withColumn("source", F.lit(n)) for i, (n, d) in enumerate(parts)]
    first = F.min(F.struct("_order", "source"))["source"].alias("source")
    return reduce(DataFrame.unionByName, tagged).groupBy("query_id", "doc_id").agg(first)


def triplets(pairs: DataFrame, most: int, seed: int) -> DataFrame:
    """pairs (query_id, doc_id, grade): each positive with one negative of its query, chosen by place: the n-th positive takes the n-th shuffled negative, in turn.

    A join on places instead of all positives with all negatives; at most `most` triplets a query."""
    w = lambda s: Window.partitionBy("query_id").orderBy(*shuffled(s, "doc_id"))
    pos = pairs.where("grade > 0").withColumn("_p", F.row_number().over(w(seed)) - 1).where(F.col("_p") < most)
    neg = pairs.where("grade <= 0").withColumn("_p", F.row_number().over(w(seed + 1)) - 1)
    sizes = neg.groupBy("query_id").agg(F.count("*").alias("_n"))
    want = pos.join(sizes, "query_id").select("query_id", F.col("doc_id").alias("positive"), (F.col("_p") % F.col("_n")).alias("_p"))
    return want.join(neg.select("query_id", "_p", F.col("doc_id").alias("negative")), ["query_id", "_p"]).select("query_id", "positive", "negative")


def siblings(categories: DataFrame, path: str) -> DataFrame:
    """(category, sibling): other leaves under the same parent path."""
    rows = categories.select(F.col(path).alias("category")).distinct().withColumn("_parent", F.regexp_replace("category", "/[^/]*$", ""))
    return rows.join(rows.select(F.col("category").alias("sibling"), "_parent"), "_parent").where("category <> sibling").select("category", "sibling")


def scarcest_bucket(rows: DataFrame, buckets: str, targets: dict[str, int], key: str, score: str) -> DataFrame:
    """Each row goes to that of its buckets with the least supply for its target; each bucket keeps its best `target` rows."""
    supply = rows.select(F.explode(buckets).alias("_b")).groupBy("_b").agg(F.count("*").alias("_have"))
    aim = F.coalesce(*[F.when(F.col("_b") == b, F.lit(float(n))) for b, n in targets.items()])
    ratio = supply.withColumn("_aim", aim).where("_aim IS NOT NULL").withColumn("_ratio", F.round(F.col("_have") / F.col("_aim"), 9))
    each = rows.select(key, score, F.explode(buckets).alias("_b")).join(F.broadcast(ratio), "_b")
    chosen = each.groupBy(key, score).agg(F.min(F.struct("_ratio", "_b", "_aim")).alias("_m"))
    out = chosen.select(key, score, F.col("_m._b").alias("bucket"), F.col("_m._aim").alias("_aim"))
    return per_group(out, ["bucket"], F.col("_aim"), [F.desc(score), F.col(key)]).drop("_aim")


def false_negative_filter(candidates: DataFrame, factor: float) -> DataFrame:
    """Without candidates that score above factor * their query's best relevant document."""
    best = F.max(F.when(F.col("grade") > 0, F.col("score"))).over(Window.partitionBy("query_id"))
    return candidates.withColumn("_best", best).where((F.col("grade") > 0) | F.col("_best").isNull() | (F.col("score") <= factor * F.col("_best"))).drop("_best")


def inverse_sqrt_weight(score: Column, most: float) -> Column:
    return most / F.sqrt(most - score + 1)


def linear_weight(score: Column, position: Column, most: float = 100.0, least: float = 0.01) -> Column:
    """score / most between least and 1; 1 / position where the score is null."""
    return F.coalesce(F.greatest(F.lit(least), F.least(F.lit(1.0), score / most)), 1.0 / position)


def uniform(seed: int, *keys: Column) -> Column:
    return hashed_unit(str(seed), *keys)
