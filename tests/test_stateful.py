"""Order-dependent streams: equal to their batch forms and to plain sequential versions, over restarts, and ending by themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievery.operators import profiling, retrieval, sampling
from sievery.plans.ordered import TARGETS, bucketed_events
from sievery.streaming import events as ev
from sievery.streaming import stateful as st

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", (F.col("user_id") % 4).alias("user_id"), "event_type", "value")


def fed(rows, path, first, last, key="event_id"):
    rows.where((F.col(key) >= first) & (F.col(key) < last)).coalesce(1).write.mode("append").parquet(path)


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).collect()), key=repr)


def test_groups_of_a_key_over_restarts(spark, tmp_path):
    """Three runs over files that cut groups apart; a late row for each user ends the last groups."""
    e = events(spark).withColumn("event_type", F.when(F.col("event_id") % 7 > 0, F.col("event_type")))
    n, path, out, check = e.count(), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    bounds = [0, n // 5, n // 2, n]
    for a, b in zip(bounds, bounds[1:], strict=False):
        fed(e, path, a, b)
        with st.state_store(spark):
            ev.run_to_table(st.keyed_groups(ev.file_stream(spark, path, e.schema), "user_id", "event_type", "event_id", "ts", "1 second"), out, check)
    closing = spark.createDataFrame([(n + u, u, "closing") for u in range(4)], "event_id long, user_id long, event_type string").select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), "user_id", "event_type", F.lit(0.0).alias("value"))
    fed(closing, path, n, n + 4)
    with st.state_store(spark):
        ev.run_to_table(st.keyed_groups(ev.file_stream(spark, path, e.schema), "user_id", "event_type", "event_id", "ts", "1 second"), out, check)
    got = spark.read.parquet(out)
    want = profiling.runs_of_key(e, "event_type", "event_id", ("user_id",))
    columns = ["user_id", "run", "event_id", "event_type", "value"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.groupBy("user_id", "run").agg(F.max("nth").alias("m"), F.count("*").alias("c")).where("m <> c").count() == 0


def test_a_timer_ends_a_group(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id long, ts timestamp, scope string, key string"
    first = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "x", 5), (3, "b", "y", 8)], "id long, scope string, key string, s int")
    later = spark.createDataFrame([(4, "a", "x", 500), (5, "c", "z", 2000), (6, "c", "w", 2001)], "id long, scope string, key string, s int")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part in (first, later):
        part.select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "scope", "key").coalesce(1).write.mode("append").parquet(path)
        with st.state_store(spark):
            ev.run_to_table(st.keyed_groups(ev.file_stream(spark, path, schema), "scope", "key", "id", "ts", "1 second", idle_ms=60_000), out, check)
    got = sorted((r["scope"], r["run"], r["id"]) for r in spark.read.parquet(out).collect())
    # the watermark, 2000 seconds on, ends all groups of a and b; row 4 came after a's first group was due, but before its timer fired
    assert [g for g in got if g[0] in "b"] == [("b", 1, 3)]
    assert [(s, i) for s, _, i in got if s == "a"] == [("a", 1), ("a", 2), ("a", 4)]
    assert ("c", 1, 5) in got and not any(i == 6 for _, _, i in got)


def sequential(rows, targets, forget=float("inf")):
    room, seen, out = dict(targets), {}, []
    for at, item, names in sorted(rows, key=lambda r: r[0]):
        needed = sorted({b for b in names or [] if room.get(b, 0) > 0})
        if needed and at - seen.get(item, float("-inf")) > forget or needed and item not in seen:
            seen[item] = at
            out.append((at, item, tuple(needed)))
            for b in needed:
                room[b] -= 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_quota_is_the_sequential_scan(spark, tmp_path, seed):
    """Ids that come back with other buckets, null and unknown buckets, buckets that never fill."""
    r = random.Random(seed)
    rows = [(i, r.choice([r.randrange(40), i]), r.choice([None, [], *[r.sample("abcde", r.randint(1, 4)) for _ in range(12)]])) for i in range(1500)]
    targets = {"a": 30, "b": 5, "c": 1, "d": 4000 if seed == 1 else 60}
    frame = spark.createDataFrame(rows, "at long, item long, names array<string>").repartition(5)
    want = sequential(rows, targets)
    batch = sampling.greedy_quota(frame, "item", "names", "at", targets).select("at", "item", "needed").collect()
    assert sorted((a, i, tuple(n)) for a, i, n in batch) == want
    forget = 100 if seed == 2 else None
    path, one = str(tmp_path / "in"), frame.withColumn("scope", F.lit("all"))
    for k in range(3):
        fed(one, path, 500 * k, 500 * k + 500, "at")
        with st.state_store(spark):
            ev.run_to_table(st.greedy_quota_stream(ev.file_stream(spark, path, one.schema), "scope", "item", "names", "at", targets, forget), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).select("at", "item", "needed").collect()
    assert sorted((a, i, tuple(sorted(n))) for a, i, n in got) == sequential(rows, targets, forget or float("inf"))


def test_greedy_quota_of_events(spark):
    e = bucketed_events(spark.read.parquet(f"{SF}/events.parquet"))
    rows = [(r["event_id"], r["user_id"], r["buckets"]) for r in e.collect()]
    got = sampling.greedy_quota(e, "user_id", "buckets", "event_id", TARGETS).collect()
    assert sorted((r["event_id"], r["user_id"], tuple(r["needed"])) for r in got) == sequential(rows, TARGETS) != []


def test_last_vectors(spark, tmp_path):
    """Batch and stream against a loop, with a ring smaller than a batch, and zero vectors."""
    r = np.random.default_rng(3)
    rows = [(i, int(i % 11 == 0), (r.normal(size=6) * (i % 13 > 0)).tolist(), (r.normal(size=4) + 1).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "at long, shard int, image array<float>, words array<float>").repartition(3)
    views, size = {"image": 0.8, "words": 0.97}, 30
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = []
    for at, shard, image, words in rows:
        past = [x for x in rows if x[1] == shard and x[0] < at][-size:]
        want.append((shard, at, len(past), sum(unit(image) @ unit(x[2]) > 0.8 or unit(words) @ unit(x[3]) > 0.97 for x in past)))
    got = retrieval.similar_to_last(frame, "shard", "at", views, size)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    path = str(tmp_path / "in")
    for a, b in ((0, 17), (17, 250), (250, 400)):
        fed(frame, path, a, b, "at")
        with st.state_store(spark):
            ev.run_to_table(st.last_vectors_stream(ev.file_stream(spark, path, frame.schema), "shard", "at", views, size, ["shard", "at"]), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [tuple(x) for x in stored(spark, str(tmp_path / "out"))] == sorted(want, key=repr)


@pytest.mark.parametrize(("target", "most"), [(90, 10**6), (10**6, 333), (10**6, 10**6)])
def test_a_scan_ends_itself(spark, tmp_path, target, most):
    """Files after the stop are broken: reading one would fail. A second call finds the work done."""
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("kind"))
    path, whole = tmp_path / "in", target == most
    for k in range(5 if whole else 3):
        fed(rows, str(path), 150 * k, 150 * k + 150, "id")
    names = sorted(path.glob("part-*"), key=lambda p: p.stat().st_mtime)
    for k, p in enumerate(names):
        import os

        os.utime(p, (1_600_000_000 + k, 1_600_000_000 + k))
    if not whole:
        for k in range(4):
            (path / f"part-9{k}.parquet").write_bytes(b"PAR1 broken PAR1")
    stream = ev.file_stream(spark, str(path), "id long, kind long")
    for _ in range(2):
        counts = st.run_until(stream, str(tmp_path / "out"), str(tmp_path / "check"), F.col("kind") == 1, "id", target, most)
        want = [r for r in range(750 if whole else 450) if r % 3 == 1 and r < most][:target]
        assert counts == {"examined": min(most, want[-1] + 1 if len(want) == target else 750), "written": len(want)}
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == want
