"""The registry of queries and the tables and runs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.functions.vectors import doubles, prefix, unit
from sievery.operators.retrieval import knn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in a file that Spark reads in fewer tasks than it has cores are dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, vector (unit, array<double>) of all embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", unit(doubles(F.col("embedding"))).alias("vector"))


def query_vectors(gallery: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 50."""
    return gallery.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")


def labelled(run: DataFrame, gallery: DataFrame) -> DataFrame:
    """A run with grade: 1 where query and document have the same label."""
    labels = gallery.select("doc_id", "label")
    q = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql"))
    return run.join(labels, "doc_id").join(q, "query_id").withColumn("grade", (F.col("label") == F.col("ql")).cast("int")).drop("ql", "label")


def run_full(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    g = vectors(spark, sf_dir)
    return labelled(knn(query_vectors(g), g, k), g)


def run_prefix(spark: SparkSession, sf_dir: str, k: int = 100, dims: int = 16) -> DataFrame:
    g = vectors(spark, sf_dir)
    short = g.withColumn("vector", prefix(F.col("vector"), dims))
    return labelled(knn(query_vectors(short), short, k), g)


def relevant(gallery: DataFrame) -> DataFrame:
    """query_id and how many other documents have its label."""
    sizes = gallery.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    return query_vectors(gallery).join(sizes, "label").select("query_id", "n_rel")


#: SQL of the same: e (unit vectors), run_a and run_b (100 nearest by 64 and by 16 dimensions, with grade), rel.
RUNS_SQL = """
e0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
e AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e0),
short AS (SELECT vec_id, label, list_transform(u[1:16], lambda x: x / sqrt(list_inner_product(u[1:16], u[1:16]))) AS u FROM e),
run_a AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.u, d.u), 6) AS score, (q.label = d.label)::INT AS grade,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.u, d.u), 6) DESC, d.vec_id) AS rank
  FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id QUALIFY rank <= 100),
run_b AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.u, d.u), 6) AS score, (q.label = d.label)::INT AS grade,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.u, d.u), 6) DESC, d.vec_id) AS rank
  FROM short q, short d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id QUALIFY rank <= 100),
rel AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM e d WHERE d.label = q.label) - 1 AS n_rel FROM e q WHERE q.vec_id % 50 = 0)
"""
