"""Structured Streaming forms of scans that stop at quotas, skip what they have seen, or group what arrives together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def quota_stream(rows: DataFrame, by: str, order: str, quota: int, schema: str) -> DataFrame:
    """The first `quota` rows of each stratum; the state of a stratum is how many it has had."""

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        for batch in batches:
            some = batch.sort_values(order).head(max(0, quota - had))
            had += len(some)
            if len(some):
                yield some
        state.update((had,))

    return rows.groupBy(by).applyInPandasWithState(take, schema, "had long", "append", GroupStateTimeout.NoTimeout)


def first_seen(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key; state older than the watermark goes."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counts(rows: DataFrame, time: str, by: str, length: str, delay: str) -> DataFrame:
    """Rows by window and key; an extension beyond batch scans."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available now into a Parquet table; a second call resumes where the checkpoint ends."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
