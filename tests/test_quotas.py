"""Quotas against a loop that deals the total out, one group of nine tenths of all rows, nulls and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievery.operators import quotas


def dealt(sizes, weights, total):
    """Real shares by repeated sharing, then the largest remainders."""
    total, share, open_ = min(total, sum(sizes.values())), {}, dict(sizes)
    while open_:
        level = (total - sum(share.values())) / sum(weights[g] for g in open_)
        full = [g for g in open_ if sizes[g] < level * weights[g] - 1e-12]
        if not full:
            share |= {g: level * weights[g] for g in open_}
            break
        for g in full:
            share[g] = float(open_.pop(g))
    base = {g: int(share[g] + 1e-9) for g in sizes}
    order = sorted(sizes, key=lambda g: (-round(share[g] - base[g], 9), g is None, g or ""))
    for g in order[: total - sum(base.values())]:
        base[g] += 1
    return base


@pytest.mark.parametrize("seed", range(4))
def test_filled_is_dealing_out(spark, seed):
    r = random.Random(seed)
    sizes = {(None if k == 3 else f"g{k}"): r.choice([0, 1, 5, 40, 900]) for k in range(12)}
    weights = {g: float(r.choice([1, 1, 2, 7])) for g in sizes}
    groups = spark.createDataFrame([(g, n, weights[g]) for g, n in sizes.items()], "g string, n long, w double")
    for total in (0, 1, 17, 100, sum(sizes.values()) - 1, 10**6):
        got = {x["g"]: x["quota"] for x in quotas.filled(groups, "g", total).collect()}
        assert got == dealt(sizes, weights, total)
        assert sum(got.values()) == min(total, sum(sizes.values()))


def test_samples_have_the_exact_total(spark):
    """A group of nine tenths of 20,000 rows, a null group, small ones."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 100 == 0, None).when(F.col("id") % 1000 == 10, "tiny").otherwise("rest").alias("g"))
    for total in (0, 10, 999, 25_000):
        some = quotas.shared_sample(rows, "g", total, 5, "id")
        assert some.columns == ["id", "g"] and some.count() == some.select("id").distinct().count() == min(total, 20_000)
    sizes = Counter(x["g"] for x in quotas.shared_sample(rows, "g", 1000, 5, "id").collect())
    assert sizes == {"hot": 390, "rest": 390, None: 200, "tiny": 20}
    again = quotas.shared_sample(rows.repartition(7), "g", 1000, 5, "id")
    assert {x["id"] for x in again.collect()} == {x["id"] for x in quotas.shared_sample(rows, "g", 1000, 5, "id").collect()}
    assert quotas.shared_sample(rows.limit(0), "g", 10, 5, "id").count() == 0


def test_proportional_and_oversampled(spark):
    rows = spark.createDataFrame([("a",)] * 900 + [("b",)] * 90 + [("c",)] * 6 + [(None,)] * 4, "g string")
    got = {x["g"]: x["quota"] for x in quotas.proportional_quotas(rows, "g", 100, 5).collect()}
    assert sum(got.values()) == 100 and got["c"] >= 5 and got[None] == 4 and got["a"] > got["b"] >= 5
    few = {x["g"]: x["quota"] for x in quotas.proportional_quotas(rows, "g", 6, 5).collect()}
    assert sum(few.values()) == 6
    w = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 0.01)], "g string, w double")
    total = {x["g"]: x["quota"] for x in quotas.oversampled_quotas(w, 1000, 200).collect()}
    first = {g: max(200, int(1000 * v / 4.01)) for g, v in (("x", 3.0), ("y", 1.0), ("z", 0.01))}
    assert total == {g: max(200, int(q * (1000 / sum(first.values())))) for g, q in first.items()}


def test_no_relevant_row_is_lost(spark):
    corpus = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("g"))
    truth = spark.createDataFrame([(i,) for i in [*range(0, 200, 3), *range(0, 30, 3), 5000, None]], "doc_id long")
    for total in (300, 67, 10, 5000):
        kept = quotas.truth_preserving(corpus, truth, "g", total, 3).collect()
        by = Counter(x["kept_for"] for x in kept)
        assert by["truth"] == 67 and len(kept) == len({x["doc_id"] for x in kept}) == max(67, min(total, 1000))
        assert {x["doc_id"] for x in kept if x["kept_for"] == "truth"} == set(range(0, 200, 3))
