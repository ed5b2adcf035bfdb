"""Work that can stop and go on: chunks with fingerprints of their content, results by id, and point lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievery.sources.tables import exists


def digest(*parts: Column) -> Column:
    """The first 48 bits of the MD5 of the parts, nulls apart from empty ones."""
    cells = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 12), 16, 10)


def chunk_of(key: Column, chunks: int) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % chunks).cast("int")


def fingerprints(rows: DataFrame, key: str, content: list[str], chunks: int) -> DataFrame:
    """chunk, n, print: how many rows each chunk of the key has, and the sum of their digests, whatever their order.

    A row added, gone, doubled or changed changes the print. One aggregation with a row a chunk and task."""
    each = rows.select(chunk_of(F.col(key), chunks).alias("chunk"), digest(F.col(key), *[F.col(c) for c in content]).cast("decimal(38,0)").alias("d"))
    return each.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("d").cast("string").alias("print"))


MANIFEST = "chunk int, print string, data string, rows long, at long"


def resumed(rows: DataFrame, key: str, content: list[str], compute: Callable[[DataFrame], DataFrame], store: str, chunks: int = 64, wave: int = 8, label: str = "") -> DataFrame:
    """compute(rows), of which the store keeps each chunk until its rows, or the label (of compute's version), change.

    Chunks with another fingerprint than the store's are computed, `wave` of them in a job; a wave's result is a Parquet
    folder, and only when it is whole does the manifest get its rows. So a run that is killed has lost one wave at most, and
    the next one goes on with the rest. compute must treat rows independently and keep the key. What comes to the driver is
    a row a chunk. Replaced folders stay until the store's owner clears them."""
    spark = rows.sparkSession
    known = {}
    if exists(spark, f"{store}/manifest"):
        for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifest").collect():
            if r["chunk"] not in known or known[r["chunk"]]["at"] < r["at"]:
                known[r["chunk"]] = r
    now = {r["chunk"]: f"{label}|{chunks}|{r['n']}|{r['print']}" for r in fingerprints(rows, key, content, chunks).collect()}
    stale = sorted(c for c, p in now.items() if c not in known or known[c]["print"] != p)
    at = max([0, *(r["at"] for r in known.values())])
    chunk = chunk_of(F.col(key), chunks)
    schema = compute(rows).schema
    for k in range(0, len(stale), wave):
        some = stale[k : k + wave]
        data = f"{store}/data/{uuid.uuid4().hex}"
        compute(rows.where(chunk.isin(some))).withColumn("_chunk", chunk).repartition("_chunk").write.partitionBy("_chunk").parquet(data)
        made = spark.read.schema(T.StructType([*schema.fields, T.StructField("_chunk", T.IntegerType())])).parquet(data).groupBy("_chunk").count()
        counts = dict(made.collect())
        done = [(c, now[c], f"{data}/_chunk={c}", counts.get(c, 0), at + 1 + k) for c in some]
        spark.createDataFrame(done, MANIFEST).coalesce(1).write.mode("append").parquet(f"{store}/manifest")
        known |= {c: {"data": d, "rows": n, "at": a} for c, _, d, n, a in done}
    paths = [known[c]["data"] for c in sorted(now) if known[c]["rows"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def remembered(ids: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """compute(ids) for the distinct non-null ids, from the table at `path` where that covers them; what it lacks is computed and added.

    compute gives rows with the key. An id for which it gives none is asked for again next time."""
    spark, wanted = ids.sparkSession, ids.select(key).where(F.col(key).isNotNull()).distinct()
    schema = compute(wanted.limit(0)).schema
    had = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    missing = wanted.join(had, key, "left_anti")
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(wanted, key, "left_semi") if exists(spark, path) else had


def within(key: Column, values: list, gaps: int = 15) -> Column:
    """key is one of the values: an exact test, and before it ranges around them, cut at the widest gaps between numbers, which reach the scan as filters."""
    known = sorted(values)
    cuts: list[int] = []
    if all(isinstance(v, (int, float)) for v in known):
        cuts = sorted(sorted(range(1, len(known)), key=lambda k: known[k - 1] - known[k])[:gaps])
    inside = F.lit(False)
    for a, b in zip([0, *cuts], [*cuts, len(known)], strict=True):
        inside = inside | ((key >= F.lit(known[a])) & (key <= F.lit(known[b - 1])))
    return inside & key.isin(known)


def looked_up(wanted: DataFrame, rows: DataFrame, key: str, value: str, most: int = 10_000) -> DataFrame:
    """wanted with the value of its key in rows; an empty string where the key is unknown or null, or the value null.

    Up to `most` distinct keys are counted and brought to the driver, so that the scan of rows skips row groups and files
    without any of them; more are joined. Of several rows with one key the least value counts."""
    names = [r[0] for r in wanted.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    some = rows.select(key, value) if len(names) > most else rows.where(within(F.col(key), names) if names else F.lit(False)).select(key, value)
    found = some.groupBy(key).agg(F.min(value).alias(value))
    return wanted.join(found, key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("")))
