"""Pairs of neighbouring words against brute force, in small steps."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sievery.operators import profiling

LISTS = [["a", "b", "a", "b"], [], None, ["a"], ["b", "a", "b"], [], ["a", "b"], ["b"]]


def test_pairs_stay_within_a_list():
    want = Counter(f"{x} {y}" for w in LISTS for x, y in zip(w or [], (w or [])[1:]))
    for step in (1, 2, 3, 100):
        got = Counter()
        for b in profiling.counted_pairs(iter([pa.record_batch([pa.array(LISTS[i:j], pa.list_(pa.string()))], names=["w"]) for i, j in ((0, 3), (3, 8))]), step):
            for v, n in zip(b["value"].to_pylist(), b["n"].to_pylist()):
                got[v] += n
        assert got == want


def test_partitions_grow_with_the_input(spark):
    rows = spark.createDataFrame([("x y z",), (None,), ("x y",)], "text string").repartition(6)
    got = profiling.token_frequencies(rows, F.col("text"), 5, pairs=True)
    assert [tuple(r) for r in got.collect()] == [("x y", 2), ("y z", 1)]
    assert "hashpartitioning(value" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 48)" in plan
