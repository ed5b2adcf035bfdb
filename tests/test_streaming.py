"""Streams run to completion give what the batch form gives, and resume."""

from pyspark.sql import functions as F

from sievery.operators import sampling
from sievery.streaming import events as ev

SF = "/root/testdata/sf0.001"


def parts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type")
    for i in range(3):
        e.where(F.col("event_id") % 1000 >= 334 * i).where(F.col("event_id") % 1000 < 334 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, str(tmp_path / "in")


def test_quota_stream_keeps_the_quota(spark, tmp_path):
    e, path = parts(spark, tmp_path)
    stream = ev.file_stream(spark, path, e.schema)
    out = ev.quota_stream(stream, "event_type", "event_id", 20, "event_id long, ts timestamp, user_id long, event_type string")
    ev.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["event_type"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    want = {r["event_type"]: r["n"] for r in sampling.running_quota(e, "event_type", "event_id", 20).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    ev.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "check"))  # nothing new arrives
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(want.values())


def test_first_seen(spark, tmp_path):
    e, path = parts(spark, tmp_path)
    ev.run_to_table(ev.first_seen(ev.file_stream(spark, path, e.schema), "user_id", "ts", "365 days"), str(tmp_path / "seen"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == e.select("user_id").distinct().count()
