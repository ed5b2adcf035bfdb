"""The pipeline's stages, each against a brute-force reading of its decisions."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sievery.llm.common import documents, written

from .conftest import SF
from .test_near_dedup import brute


def test_stages(spark):
    # the smallest table holds no secrets: some are planted
    secret = F.concat("text", F.lit(' token = "'), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lit('"'))
    planted = written(documents(spark, SF).withColumn("text", F.when(F.col("doc_id") % 10 == 0, secret).otherwise(F.col("text"))), "planted")
    docs, tables = planted, []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        tables.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    start = [r.asDict() for r in documents(spark, SF).collect()]
    good, unique, clean, mix, packed = (t[2] for t in tables)
    assert all(t[1] == cp.COLUMNS for t in tables[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    dropped = {d["doc_id"] for d in start} - {d["doc_id"] for d in good}
    assert dropped and sum(labels.get(i, 0) == 1 for i in dropped) <= 0.1 * len(dropped) + 1
    groups = brute([(d["doc_id"], d["text"]) for d in good])
    assert sorted(d["doc_id"] for d in unique) == sorted(i for i, (_, c) in groups.items() if i == c)
    before = {d["doc_id"]: d["text"] for d in unique}
    assert {d["doc_id"] for d in clean} == set(before) and all(len(d["text"]) == d["n_chars"] for d in clean if d["text"] != before[d["doc_id"]])
    assert any("<SECRET>" in d["text"] for d in clean)
    times = Counter(d["doc_id"] for d in mix)
    assert max(times.values()) <= 2 and set(times) <= {d["doc_id"] for d in clean}
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == times
