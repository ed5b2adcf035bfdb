"""Places, runs and quotas against brute force, with the rows spread over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievery.operators import places, profiling, sampling


@pytest.fixture
def spread(spark):
    """Shuffles of 16 partitions that stay as they are."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def table(spark):
    rows = [(i * i, None if i % 90 == 7 else "a" if i % 10 < 8 else "b") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, key string").repartition(5)


def largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_runs_match_brute_force(spark, spread):
    rows, df = table(spark)
    want, run, last = {}, 0, None
    for i, k in rows:
        run, last = run + (k != last), k
        want[i] = run
    got = profiling.runs_of_key(df, "key", "id")
    assert {r["id"]: r["run"] for r in got.collect()} == want
    assert largest_task(got) < 1500
    assert profiling.runs_of_key(df.limit(0), "key", "id").collect() == []


def test_places_match_brute_force(spark, spread):
    rows, df = table(spark)
    seen, want = Counter(), {}
    for i, k in rows:
        seen[k] += 1
        want[i] = seen[k]
    got = places.numbered(places.binned(df, "id"), ["key"], ["id"])
    assert {r["id"]: r["_nth"] for r in got.collect()} == want
    assert largest_task(got) < 1500


def test_proportional_sample_is_spread(spark, spread):
    _, df = table(spark)
    got = sampling.proportional_sample(df, "key", 3000, 10, 7, "id")
    assert {r["key"]: r["count"] for r in got.groupBy("key").count().collect()} == {r["key"]: r["count"] for r in df.where("key IS NOT NULL").groupBy("key").count().collect()}
    assert largest_task(got) < 1500
