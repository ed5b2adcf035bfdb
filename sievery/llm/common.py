"""Shared helpers: the input table, intermediate tables in the shared folder, and bounded deterministic samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text: runs of anything but space, \t, \n, \v, \f and \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a task looks at together, and of an Arrow batch; a longer text is a slice or batch of its own.
SLICE, ARROW = 1 << 20, 8 << 20
_resident: dict = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; a file that Spark reads in fewer tasks than it has cores is dealt to all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode only, a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(df: DataFrame, by: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """At most per_value rows for each value of `by`: the least hash of the key in each of per_value hash bins.

    One pre-aggregated group-by, so neither a window nor a large group; the same rows at each run."""
    order = F.struct(F.xxhash64(key).alias("h"), *[F.col(c) for c in df.columns if c != by])
    bins = df.groupBy(by, F.pmod(F.xxhash64(F.col(key), F.lit("bin")), F.lit(per_value)).alias("_bin")).agg(F.min(order).alias("_row"))
    return bins.select(by, "_row.*").drop("h")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def mapped(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """rows.mapInArrow(each, schema) with Arrow batches of at most ARROW bytes or one row: long texts don't fill a worker."""
    conf = rows.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))) > ARROW:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW))
    return rows.mapInArrow(each, schema)


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (column number `text`) take at most `most` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def resident(key: tuple, make: Callable[[], object]) -> object:
    """make(), kept for the Python worker's life until another key is asked for: a reused worker holds one operator's model."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]
