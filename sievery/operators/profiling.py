"""Profiles of texts, values and labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievery.functions.text import tokens, word_count

from .places import binned
from .retrieval import BATCH


def text_profile(rows: DataFrame, text: Column) -> DataFrame:
    """One row: counts, null rate, distinct texts, share of repeated ones, words and characters, buckets of words."""
    t = rows.select(text.alias("t")).withColumn("w", F.when(F.col("t").isNotNull(), word_count(F.col("t"))))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.agg(
        F.count("*").alias("rows"), share(F.col("t").isNull()).alias("null_rate"), F.count_distinct("t").alias("unique_texts"),
        F.round(1 - F.count_distinct("t") / F.count("t"), 6).alias("duplicate_rate"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.avg("w"), 6).alias("mean_words"),
        F.round(F.avg(F.length("t")), 6).alias("mean_chars"), share(F.col("w") <= 8).alias("short"), share((F.col("w") > 8) & (F.col("w") <= 25)).alias("medium"), share(F.col("w") > 25).alias("long"),
    )


def by_position(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """share, value: the value at place int(n * share) of the ascending order, an element and not an interpolation.

    Values are counted first; running sums over the distinct values find the places."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    w = Window.orderBy(value)
    placed = counts.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    wanted = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", F.floor(F.col("n") * F.col("share")))
    return wanted.where((F.col("at") >= F.col("to") - F.col("c")) & (F.col("at") < F.col("to"))).select("share", F.col(value).alias("value"))


def frequencies(rows: DataFrame, value: Column, top: int) -> DataFrame:
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def counted_pairs(batches: Iterator[pa.RecordBatch], step: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """value, n: the pairs of neighbours in the lists of strings of each batch, counted within `step` of them."""
    for batch in batches:
        lists = batch.column(0)
        words = lists.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) - 1
        inside = np.ones(len(words), bool)
        inside[ends[ends >= 0]] = False  # an empty list's end is the one before
        for a in range(0, len(words) - 1, step):
            n = min(step, len(words) - 1 - a)
            some = pa.array(inside[a : a + n])
            pairs = pc.binary_join_element_wise(words.slice(a, n).filter(some), words.slice(a + 1, n).filter(some), " ").value_counts()
            yield pa.record_batch([pairs.field("values"), pairs.field("counts")], names=["value", "n"])


def token_frequencies(rows: DataFrame, text: Column, top: int, pairs: bool = False) -> DataFrame:
    """The most frequent tokens, or pairs of neighbours.

    Pairs have so many values that a task's table of them would grow with the input: they are counted a batch at a time
    and then dealt to partitions whose number grows with that of the input's."""
    words = tokens(text)
    if not pairs:
        return frequencies(rows.select(F.explode(words).alias("t")), F.col("t"), top)
    conf = rows.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), 8 * rows.rdd.getNumPartitions())
    counts = rows.select(words.alias("w")).mapInArrow(counted_pairs, "value string, n long").repartition(parts, "value")
    return counts.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def concentration(rows: DataFrame, value: str) -> DataFrame:
    """The shares that the five and ten most frequent values hold."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), value).limit(10).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), value)))
    return top.agg(F.sum(F.when(F.col("r") <= 5, F.col("n"))).alias("n5"), F.sum("n").alias("n10")).join(F.broadcast(total)).select(F.round(F.col("n5") / F.col("total"), 6).alias("top5_share"), F.round(F.col("n10") / F.col("total"), 6).alias("top10_share"))


def cooccurrence(rows: DataFrame, fields: list[str], top: int) -> DataFrame:
    """The most frequent value pairs of every two fields, in one pass of grouping sets."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("field_a"), F.col(a).cast("string").alias("value_a"), F.lit(b).alias("field_b"), F.col(b).cast("string").alias("value_b")) for a, b in pairs]))
    names = ["field_a", "value_a", "field_b", "value_b"]
    return rows.select(sides.alias("p")).groupBy(*[F.col(f"p.{n}").alias(n) for n in names]).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(top)


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    apart = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((apart == 0).cast("double")), 6).alias("exact"), F.round(F.avg((apart <= 1).cast("double")), 6).alias("within_one"), F.round(F.avg(apart), 6).alias("mean_difference"))


def runs_of_key(rows: DataFrame, key: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with run: consecutive rows of one key, in the order of a numeric column, share a number; from 1 within each group of `by`.

    Changes are counted within bins of the order; those at and before a bin's first row come from the bins' sums and
    boundary keys, a row a group and bin. No task holds a whole group."""
    w = Window.partitionBy(*by, "_bin").orderBy(order)
    inside = (F.row_number().over(w) > 1) & ~F.col(key).eqNullSafe(F.lag(key).over(w))
    placed = binned(rows, order).withColumn("_new", inside.cast("int"))
    pair = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    bins = placed.groupBy(*by, "_bin").agg(F.sum("_new").alias("c"), F.min(pair).alias("first"), F.max(pair).alias("last"))
    of_bins = Window.partitionBy(*by).orderBy("_bin")
    edge = ((F.row_number().over(of_bins) == 1) | ~F.col("first.k").eqNullSafe(F.lag("last.k").over(of_bins))).cast("long")
    earlier = F.coalesce(F.sum("c").over(of_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = bins.withColumn("edge", edge).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_of"), (F.sum("edge").over(of_bins) + earlier).alias("_start"))
    same = F.col("_bin") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    numbered = placed.withColumn("_in", F.sum("_new").over(w)).join(starts if by else F.broadcast(starts), same)
    return numbered.withColumn("run", F.col("_start") + F.col("_in")).select(*rows.columns, "run")
