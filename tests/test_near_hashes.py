"""Near hashes against all pairs, on planted copies; texts with null ids in containments."""

import random

from pyspark.sql import functions as F

from sievery.functions.text import tokens
from sievery.operators import leakage


def test_planted_near_copies(spark):
    """Groups of equal and of slightly changed texts, a hot group, nulls and empty texts."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(60, 200))] for _ in range(60)]
    texts = [" ".join(base[k % 60] if k % 3 else [*base[k % 60][:-1], f"n{k}"]) for k in range(300)] + [" ".join(base[0])] * 200 + [None, "", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4).select("id", leakage.simhash(tokens(F.col("text"))).alias("hash"))
    known = {x["id"]: x["hash"] for x in rows.collect()}
    assert known[500] is None and known[501] is None and known[502] is not None
    some = {i: h for i, h in known.items() if h is not None}
    queries = [i for i in some if i % 5 == 0]
    want = {}
    for i, h in some.items():
        near = [(bin(h ^ some[q]).count("1"), q) for q in queries if q != i and bin(h ^ some[q]).count("1") <= 6]
        if near:
            want[i] = min(near)[0]
    usable = rows.where("hash IS NOT NULL")
    got = {x["id"]: x for x in leakage.hamming_nearest(usable, F.col("id") % 5 == 0, 6).collect()}
    assert {i: x["distance"] for i, x in got.items()} == want and len(want) > 200
    for i, x in got.items():
        assert x["match"] != i and x["match"] % 5 == 0 and bin(some[i] ^ some[x["match"]]).count("1") == x["distance"]


def test_containments_keep_null_ids(spark):
    texts = spark.createDataFrame([(None, "the quick brown fox jumps"), (1, "nothing"), (None, "elsewhere")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "quick brown fox")], "item_id long, phrase string")
    assert [tuple(x) for x in leakage.containments(texts, phrases).collect()] == [(None, 7)]


def test_choices_are_not_broadcast(spark):
    rows = spark.range(300).select("id", F.xxhash64("id").bitwiseAND((1 << 60) - 1).alias("hash"))
    plan = leakage.hamming_nearest(rows, F.col("id") % 50 == 0, 6)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
