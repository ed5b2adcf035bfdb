"""Places in a sorted order without a task that holds a whole group: counts of bins are summed, windows stay within a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(rows: DataFrame, order: str) -> DataFrame:
    """rows with _bin: ascending in a numeric column, about as many bins as shuffle partitions, nulls in the first.

    The bounds, one number a bin, are approximate quantiles that are found at once and held in the plan."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    bounds = F.array(*[F.lit(x) for x in sorted(set(found))]).cast("array<double>")
    return rows.withColumn("_bin", F.size(F.filter(bounds, lambda b: b <= F.col(order))))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows (with _bin, ascending in the order) with _nth instead: the place from 1 within the group of `by`."""
    counts = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bin").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bin") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*order)))
    return within.join(starts, same).withColumn("_nth", F.col("_start") + F.col("_in")).select(*[c for c in rows.columns if c != "_bin"], "_nth")
