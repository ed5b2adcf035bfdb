"""Quotas with exact totals: shares are rounded by largest remainder, what a small group can't give is shared among the others.

Windows hold a row for each group; rows are picked by their place in the group's shuffled order, numbered over bins of
the order, so that no task holds a group, however large its share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import numbered
from .sampling import shuffled

EVERYTHING = (Window.unboundedPreceding, Window.unboundedFollowing)


def filled(groups: DataFrame, by: str, total: Column | int) -> DataFrame:
    """groups (by, n, w) with quota: `total` shared by the weights w > 0, at most n each, the excess shared again by weight until none is above.

    The level at which total / weight settles comes from the running sums in ascending order of n / w. Fractions are
    rounded down and what is left goes to the largest remainders, ties to the lesser group. The quotas sum to the total,
    or to all of n where that is less. A null group is a group of its own, last in ties."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(*EVERYTHING)
    ratio = F.col("n") / F.col("w")
    ascending = Window.orderBy(ratio, F.col(by).asc_nulls_last())
    before = F.coalesce(F.sum("n").over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(ascending.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    want = total if isinstance(total, Column) else F.lit(total)
    levels = groups.withColumn("_at", F.row_number().over(ascending)).withColumn("_level", (F.least(want, F.sum("n").over(everything)) - before) / onward)
    fixed = F.min(F.when(F.col("_level") * F.col("w") <= F.col("n"), F.struct("_at", F.col("_level").alias("level")))).over(everything)["level"]
    share = F.least(F.col("n").cast("double"), F.coalesce(F.col("_fixed") * F.col("w"), F.col("n").cast("double")))
    shared = levels.withColumn("_fixed", fixed).withColumn("_share", share).withColumn("_base", F.floor(F.col("_share") + 1e-9))
    left = F.least(want, F.sum("n").over(everything)) - F.sum("_base").over(everything)
    order = F.row_number().over(Window.orderBy(F.desc("_left_over"), F.col(by).asc_nulls_last()))
    ranked = shared.withColumn("_left_over", F.round(F.col("_share") - F.col("_base"), 9)).withColumns({"_left": left, "_order": order})
    quota = F.col("_base") + (F.col("_order") <= F.col("_left")).cast("long")
    return ranked.select(*groups.columns, quota.alias("quota"))


def sized(rows: DataFrame, by: str, weight: Column | float = 1.0) -> DataFrame:
    """(by, n, w) of the rows; weight is an expression of by and n. Groups without a positive weight are left out."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("w", w.cast("double")).where("w > 0")


def picked(rows: DataFrame, by: str, quotas: DataFrame, seed: int, key: str) -> DataFrame:
    """The first `quota` rows of each group in its shuffled order; quotas (by, quota) has a row a group."""
    order = shuffled(seed, key)
    placed = numbered(rows.withColumn("_bin", F.substring(order[0], 1, 3)), [by], order)
    want = quotas.select(F.col(by).alias("_group"), "quota")
    return placed.join(want, placed[by].eqNullSafe(want["_group"])).where("_nth <= quota").drop("_nth", "_group", "quota")


def shared_sample(rows: DataFrame, by: str, total: int, seed: int, key: str, weight: Column | float = 1.0) -> DataFrame:
    """Exactly `total` rows (all, where there are fewer): by weight, deficits refilled from the groups that have more. Weight 1: equal parts."""
    return picked(rows, by, filled(sized(rows, by, weight), by, total), seed, key)


def proportional_quotas(rows: DataFrame, by: str, total: int, floor: int) -> DataFrame:
    """(by, n, quota): each group its first `floor` rows, the rest in proportion to what is left of it, exactly `total` in all.

    Where the floors alone exceed the total they are filled in equal parts."""
    sizes = sized(rows, by)
    first = filled(sizes.withColumn("n", F.least("n", F.lit(floor))), by, total).select(F.col(by).alias("_g"), F.col("quota").alias("_first"))
    joined = sizes.join(first, sizes[by].eqNullSafe(first["_g"])).drop("_g")
    rest = joined.select(by, "_first", F.col("n").alias("_n"), (F.col("n") - F.col("_first")).alias("n"), F.greatest(F.col("n") - F.col("_first"), F.lit(1)).cast("double").alias("w"))
    left = F.lit(total) - F.sum("_first").over(Window.orderBy(F.lit(1)).rowsBetween(*EVERYTHING))
    more = filled(rest.withColumn("_left", F.greatest(left, F.lit(0))), by, F.col("_left"))
    return more.select(by, F.col("_n").alias("n"), (F.col("_first") + F.col("quota")).alias("quota"))


def oversampled_quotas(weights: DataFrame, total: int, floor: int) -> DataFrame:
    """weights (group, w) with quota: max(floor, total by weight), then scaled to the total once, never below the floor. As the floors hold, the sum may be above the total."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(*EVERYTHING)
    first = weights.withColumn("_q", F.greatest(F.lit(floor), F.floor(F.lit(total) * F.col("w") / F.sum("w").over(everything))))
    scale = F.lit(float(total)) / F.greatest(F.sum("_q").over(everything), F.lit(1))
    return first.withColumn("quota", F.greatest(F.lit(floor), F.floor(F.col("_q") * scale))).drop("_q")


def truth_preserving(corpus: DataFrame, truth: DataFrame, by: str, total: int, seed: int, key: str = "doc_id") -> DataFrame:
    """corpus with kept_for: every row that truth (key) names, as `truth`, and others up to `total` rows, as `fill`.

    The fill is shared among the groups in proportion to their other rows. Where the truth alone exceeds the total, all of
    it stays and nothing is filled: no relevant row is lost. Ids of truth that the corpus lacks count for nothing."""
    named = truth.select(F.col(key).alias("_named")).where("_named IS NOT NULL").distinct()
    marked = corpus.join(named, corpus[key] == named["_named"], "left")
    relevant, other = marked.where("_named IS NOT NULL").drop("_named"), marked.where("_named IS NULL").drop("_named")
    room = F.greatest(F.lit(total) - F.col("_have"), F.lit(0))
    have = relevant.agg(F.count("*").alias("_have"))
    groups = sized(other, by, F.col("n")).crossJoin(F.broadcast(have))  # a single row
    quotas = filled(groups, by, room)
    return relevant.withColumn("kept_for", F.lit("truth")).unionByName(picked(other, by, quotas, seed, key).withColumn("kept_for", F.lit("fill")))
