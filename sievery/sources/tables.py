"""Reading and writing: catalogs, graded relevance, splits, galleries, result registries, reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every column a string: no inference, so one scan."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {query: {doc: grade}} as (query, doc_id, rel)."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string, map<string, int>>")).alias("query", "docs"))
    return outer.select("query", F.explode("docs").alias("doc_id", "rel"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {split: [ids]} as (query_id, split)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("split", "ids")).select(F.explode("ids").alias("query_id"), "split")


def graded(raw: DataFrame, positives: str = "positive_ids", negatives: str = "negative_ids", gap: str = "[ \t,]+") -> DataFrame:
    """(query_id, id lists as strings) as (query_id, doc_id, grade): 2 for positives, 1 for negatives; a positive wins over a negative."""

    def ids(column: str, grade: int) -> DataFrame:
        return raw.select("query_id", F.explode(F.filter(F.split(F.trim(F.coalesce(column, F.lit(""))), gap), lambda x: x != "")).alias("doc_id"), F.lit(grade).alias("grade"))

    return ids(positives, 2).unionByName(ids(negatives, 1)).groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def chained(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_dense_label(rows: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """rows with the number of their label among the sorted distinct labels, from 0; the ranking window holds labels, not rows."""
    ids = rows.select(label).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(label)) - 1)
    return rows.join(ids, label)


def save_gallery(rows: DataFrame, path: str, metadata: dict) -> None:
    """Vectors and a one-row metadata table; raises if an item_id occurs twice."""
    twice = rows.groupBy("item_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"item ids must be unique: {twice[0][0]}")
    rows.write.mode("overwrite").parquet(f"{path}/items")
    rows.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").write.mode("overwrite").parquet(f"{path}/metadata")


def load_gallery(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/items"), json.loads(spark.read.parquet(f"{path}/metadata").first()[0])


def upserted(registry: DataFrame, new: DataFrame, keys: list[str], order: str, overwrite: bool = True) -> DataFrame:
    """The registry with the new rows: for each key the latest row, or the oldest unless overwrite."""
    both = registry.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = [F.desc("_new"), F.desc(order)] if overwrite else [F.col("_new"), F.col(order)]
    return both.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where("_nth = 1").drop("_nth", "_new")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table of at most `most` lines."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()])


def image_path(item_id: Column, width: int = 10) -> Column:
    """A zero-padded id's file below its first three characters."""
    padded = F.lpad(item_id.cast("string"), width, "0")
    return F.concat_ws("/", F.substring(padded, 1, 3), F.concat(padded, F.lit(".jpg")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
