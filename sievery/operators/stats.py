"""Resampling, intervals, comparisons of two systems and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resampled_means(values: DataFrame, by: list[str], value: str, resamples: int, seed: int = 42) -> DataFrame:
    """by..., replicate, mean: bootstrap means of each group's rows in the order of `pos`.

    values needs pos (0 .. n - 1 within the group) and n. Draws are MD5 numbers of (seed, replicate, draw), so any
    engine makes the same ones. A row draws for each replicate which position it takes; positions join on equality."""
    slots = values.select(*by, "pos", "n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = slots.select(*by, "replicate", F.floor(u * F.col("n")).alias("pos"))
    return drawn.join(values.select(*by, "pos", value), [*by, "pos"]).groupBy(*by, "replicate").agg(F.avg(value).alias("mean"))


def positioned(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return rows.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))


def interval(means: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    lo = (1 - level) / 2
    return means.groupBy(*by).agg(F.expr(f"percentile(mean, {lo})").alias("lo"), F.expr(f"percentile(mean, {1 - lo})").alias("hi"))


def paired_test(means: DataFrame, by: list[str]) -> DataFrame:
    """Of bootstrap means of differences: p two-sided and one-sided, the interval, and whether it excludes 0."""
    below, above = F.avg((F.col("mean") <= 0).cast("double")), F.avg((F.col("mean") >= 0).cast("double"))
    out = means.groupBy(*by).agg(F.least(2 * F.least(below, above), F.lit(1.0)).alias("p_two_sided"), below.alias("p_one_sided"), F.expr("percentile(mean, 0.025)").alias("lo"), F.expr("percentile(mean, 0.975)").alias("hi"))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def normal_interval(mean: Column, n: Column) -> tuple[Column, Column]:
    half = 1.96 * F.sqrt(mean * (1 - mean) / n)
    return mean - half, mean + half


def win_loss(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "win").when(hi < 0, "loss").otherwise("inconclusive")


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both, a only, b only, neither, and the rate of any."""
    x, y = F.col(a) > 0, F.col(b) > 0
    return pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"), F.avg((x | y).cast("double")).alias("any_rate"))


def word_failure_rate(rows: DataFrame, words: str, failed: str, least: int = 20) -> DataFrame:
    """word, n, rate over the distinct words of each row, for words in at least `least` rows."""
    each = rows.select(F.explode(F.array_distinct(words)).alias("word"), F.col(failed).cast("double").alias("f"))
    return each.groupBy("word").agg(F.count("*").alias("n"), F.avg("f").alias("rate")).where(F.col("n") >= least)
