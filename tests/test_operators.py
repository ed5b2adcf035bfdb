"""Literal cases, traps and sources."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.functions.vectors import composed, norm
from sievery.operators import fusion, leakage, metrics, sampling, understanding
from sievery.sources import tables


def run(spark, grades):
    return spark.createDataFrame([("q", f"d{i}", i, g) for i, g in enumerate(grades, 1)], "query_id string, doc_id string, rank int, grade int")


@pytest.mark.parametrize(("grades", "k", "want"), [([2, 1, 0], 3, 1.0), ([0, 0, 0], 3, 0.0), ([1], 10, 1.0)])
def test_ndcg(spark, grades, k, want):
    assert metrics.ndcg(run(spark, grades), k).first()["ndcg"] == pytest.approx(want)


def test_ndcg_reversed_and_bad_k(spark):
    assert metrics.ndcg(run(spark, [0, 1, 2]), 3).first()["ndcg"] < 1
    with pytest.raises(ValueError, match="positive"):
        metrics.ndcg(run(spark, [1]), 0)


@pytest.mark.parametrize(("grades", "want"), [([1, 0, 0], 1), ([0, 0, 1], 1 / 3), ([0, 0, 0], 0)])
def test_mrr(spark, grades, want):
    rel = spark.createDataFrame([("q", max(sum(grades), 1))], "query_id string, n_rel int")
    assert metrics.hit_metrics(run(spark, grades), rel).first()["mrr"] == pytest.approx(want)


def test_recall_precision_ap(spark):
    rel = spark.createDataFrame([("q", 2)], "query_id string, n_rel int")
    m = metrics.hit_metrics(run(spark, [1, 1, 0]), rel, (2, 3)).first()
    assert (m["recall_2"], m["precision_3"], m["precision_2"]) == (1, pytest.approx(2 / 3), 1)
    assert metrics.average_precision(run(spark, [1, 0, 1]), rel).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.average_precision(run(spark, [0]), rel).first()["ap"] == 0
    with pytest.raises(ValueError, match="denominator"):
        metrics.average_precision(run(spark, [0]), rel, None, "min_k")


def test_three_precision_conventions_differ(spark):
    rel = spark.createDataFrame([("q", 30)], "query_id string, n_rel int")
    r = run(spark, [1] * 5 + [0] * 5 + [1] * 5)
    whole, cut, least = (metrics.average_precision(r, rel, *a).first()["ap"] for a in ((), (10,), (10, "min_k")))
    assert least == pytest.approx(0.5) and cut == pytest.approx(5 / 30) and whole > cut


def test_late_max_promotes_a_view(spark):
    rows = spark.createDataFrame([("item1", 0.0, 0.0, 0.0), ("item2", 0.0, 1.0, 0.0)], "item string, p double, a double, b double")
    best = rows.withColumn("s", fusion.late_max([F.col("p"), F.col("a"), F.col("b")], F.col("p"))).orderBy(F.desc("s")).first()
    assert best["item"] == "item2" and best["s"] == pytest.approx(0.1)


def test_composition(spark):
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert v.select(norm(composed([(F.col("a"), 1.0), (F.col("b"), 0.25)])).alias("n")).first()["n"] == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError, match="positive"):
        composed([(F.col("a"), 0.0)])


def test_rescored_keeps_order_without_any_score(spark):
    cand = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1), ("r", "c", 2)], "query_id string, doc_id string, rank int")
    scores = spark.createDataFrame([("r", "c", 0.9)], "query_id string, doc_id string, score double")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in fusion.rescored(cand, scores).collect())
    assert got == [("q", 1, "a"), ("q", 2, "b"), ("r", 1, "c")]


def test_fallback_run(spark):
    a = spark.createDataFrame([("q", "a", 1.0, 1)], "query_id string, doc_id string, score double, rank int")
    b = spark.createDataFrame([("q", "b", 1.0, 1), ("r", "b", 1.0, 1)], a.schema)
    assert {(r["query_id"], r["doc_id"]) for r in fusion.first_available(a, b).collect()} == {("q", "a"), ("r", "b")}


def test_leakage_is_loud(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",)], "k string")
    with pytest.raises(ValueError, match="y"):
        leakage.require_disjoint(a, b, "k")
    with pytest.raises(ValueError, match="x"):
        leakage.require_subset(a, b, "k")
    leakage.require_subset(b, a, "k")


def test_hamming_finds_exactly_the_near_hashes(spark):
    base = [0, -1, 0x123456789ABCDEF0, 0x7FFFFFFFFFFFFFFF]
    flips = [0, 1, 0b111111, 0b1111111, (1 << 63) | (1 << 40)]
    a = spark.createDataFrame(list(enumerate(base)), "id_a int, hash_a long")
    other = [((x ^ f) & ((1 << 64) - 1)) for x in base for f in flips]
    b = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(other)], "id_b int, hash_b long")
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in leakage.hamming_matches(a, b, 6).collect()}
    want = {(i, j): d for i, x in enumerate(base) for j, y in enumerate(other) if (d := bin((x ^ y) & ((1 << 64) - 1)).count("1")) <= 6}
    assert got == want


def test_weights_rise_and_quotas_hold(spark):
    got = spark.createDataFrame([(0.6,), (0.75,), (0.9,)], "s double").select(sampling.gaussian_weight(F.col("s")).alias("w")).collect()
    assert got[1]["w"] == 1 and math.isclose(got[0]["w"], got[2]["w"])
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "i int, g string")
    assert sorted(r["i"] for r in sampling.running_quota(rows, "g", "i", 2).collect()) == [0, 1, 2, 3]


def test_text_helpers(spark):
    row = spark.createDataFrame([(" NaN ", "x", "```json\n{\"a\": {\"b\": 1}}\n```", ["Red", "blue"])], "a string, b string, j string, v array<string>")
    got = row.select(tx.cleaned(F.col("a")).alias("a"), tx.article_text([F.col("a"), F.col("b")]).alias("t"), tx.json_object(F.col("j")).alias("j"), tx.grounded(F.col("v"), F.lit("a red shoe")).alias("v"), tx.relative_delta(F.lit(2.0), F.lit(0.0)).alias("d")).first()
    assert (got["a"], got["t"], json.loads(got["j"]), got["v"], got["d"]) == (None, "x", {"a": {"b": 1}}, ["Red"], None)


def test_sources(spark, tmp_path):
    (tmp_path / "q.csv").write_text('query_id,positive_ids,negative_ids\nq1,"a b","b c"\nq2,d,\n')
    raw = tables.read_csv(spark, str(tmp_path / "q.csv"), ["query_id", "positive_ids", "negative_ids"])
    assert {tuple(r) for r in tables.graded(raw).collect()} == {("q1", "a", 2), ("q1", "b", 2), ("q1", "c", 1), ("q2", "d", 2)}
    (tmp_path / "gt.json").write_text('{"q": {"d1": 2,\n "d2": 1}}')
    assert {tuple(r) for r in tables.read_json_map(spark, str(tmp_path / "gt.json")).collect()} == {("q", "d1", 2), ("q", "d2", 1)}
    (tmp_path / "s.json").write_text('{"train": ["a", "b"], "test": ["c"]}')
    assert {tuple(r) for r in tables.read_splits(spark, str(tmp_path / "s.json")).collect()} == {("a", "train"), ("b", "train"), ("c", "test")}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2


def test_gallery(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item_id string, parent array<double>")
    tables.save_gallery(rows, str(tmp_path / "g"), {"dim": 1})
    back, meta = tables.load_gallery(spark, str(tmp_path / "g"))
    assert back.count() == 2 and meta == {"dim": 1}
    with pytest.raises(ValueError, match="unique"):
        tables.save_gallery(rows.union(rows), str(tmp_path / "h"), {})


def test_upsert_and_markdown(spark):
    old = spark.createDataFrame([(1, "m", 0.1, 1)], "tier int, method string, score double, at int")
    new = spark.createDataFrame([(1, "m", 0.2, 2), (2, "m", 0.3, 2)], old.schema)
    for overwrite, want in ((True, 0.2), (False, 0.1)):
        got = {(r["tier"], r["method"]): r["score"] for r in tables.upserted(old, new, ["tier", "method"], "at", overwrite).collect()}
        assert got == {(1, "m"): want, (2, "m"): 0.3}
    assert tables.markdown(old).splitlines()[2] == "| 1 | m | 0.1 | 1 |"


def test_synonyms_take_the_longest_match(spark):
    q = spark.createDataFrame([(1, "blue ring"), (2, "a blue hat"), (3, "bluebird"), (4, None)], "id int, t string")
    got = {r["id"]: r["expanded"] for r in understanding.expand_synonyms(q, "t", {"blue": ["navy"], "blue ring": ["sapphire"]}).collect()}
    assert got == {1: "blue ring sapphire", 2: "a blue hat navy", 3: "bluebird", 4: None}


def test_word_hashes_of_near_texts_meet(spark):
    import random

    from pyspark.sql import functions as F

    from sievery.functions.text import tokens
    from sievery.operators import leakage

    r = random.Random(2)
    base = [f"word{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"word{r.randrange(10**6)}" for _ in range(300)), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("h", leakage.simhash(tokens(F.col("text"))))
    h = {x["id"]: x["h"] for x in rows.collect()}
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert h[3] is None and apart(h[0], h[1]) <= 6 < apart(h[0], h[2])
    some = rows.where("h IS NOT NULL")
    got = leakage.hamming_matches(some.select(F.col("id").alias("id_a"), F.col("h").alias("hash_a")), some.select(F.col("id").alias("id_b"), F.col("h").alias("hash_b")), 6)
    assert {(x["id_a"], x["id_b"], x["distance"]) for x in got.collect()} == {(a, b, apart(h[a], h[b])) for a in range(3) for b in range(3) if apart(h[a], h[b]) <= 6}


def test_exact_search_keeps_ties_by_id(spark):
    import numpy as np

    from sievery.operators import retrieval

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(700, 3)), 1)  # many ties
    g = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>").repartition(3)
    q = g.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    for options in ({}, {"block": 4}, {"block": 4, "sent": 5}):  # one block, four blocks, a grid of blocks and parts
        got = {}
        for x in retrieval.knn(q, g, 7, **options).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["doc_id"])
        assert len(got) == 14
        for i, docs in got.items():
            s = np.round(v @ v[i], 6)
            s[i] = -np.inf
            assert docs == sorted(range(700), key=lambda j: (-s[j], j))[:7]


def test_searches_in_a_grid(spark, monkeypatch):
    """More queries than go with the plan, more gallery rows than a part: counts and neighbours stay exact."""
    import numpy as np

    from sievery.operators import retrieval

    monkeypatch.setattr(retrieval, "PART", 90)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 5))
    g = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>").repartition(3)
    own = [float(np.round(v[i] @ v[(i + 1) % 600], 6)) for i in range(600)]
    q = spark.createDataFrame([(i, v[i].tolist(), own[i]) for i in range(0, 600, 3)], "query_id long, vector array<double>, own double")
    want = {i: int((np.round(v @ v[i], 6) > own[i]).sum()) for i in range(0, 600, 3)}
    assert {r["query_id"]: r["higher"] for r in retrieval.higher_counts(q, g, block=30, sent=50).collect()} == want
    near = retrieval.knn(q, g, 3, block=30, sent=50).collect()
    assert len(near) == 600 and all(r["score"] <= 1e9 for r in near)
    first = {r["query_id"]: r["doc_id"] for r in near if r["rank"] == 1}
    assert first == {i: int(np.argmax(np.where(np.arange(600) == i, -np.inf, np.round(v @ v[i], 6)))) for i in first}
    assert retrieval.knn(q.limit(0), g, 3).count() == 0


def test_packed_signs(spark):
    """Bits and searches of 3, 64 and 100 dimensions, in blocks and in a grid."""
    import numpy as np

    from sievery.functions.vectors import packed_signs
    from sievery.operators import retrieval

    rng = np.random.default_rng(8)
    for dims in (3, 64, 100):
        v = rng.normal(size=(150, dims))
        v[0] = 0.0
        g = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>").withColumn("vector", packed_signs(F.col("vector")))
        bits = {r["doc_id"]: r["vector"] for r in g.collect()}
        for i in (0, 7):
            flat = [(w >> b) & 1 for w in bits[i] for b in range(64)]
            assert flat[:dims] == (v[i] >= 0).astype(int).tolist() and not any(flat[dims:])
        s = np.where(v >= 0, 1, -1) @ np.where(v >= 0, 1, -1).T
        q = g.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
        for options in ({}, {"block": 4, "sent": 5}):
            got = {}
            for x in retrieval.knn_signs(q, g, dims, 5, **options).orderBy("query_id", "rank").collect():
                got.setdefault(x["query_id"], []).append((x["doc_id"], x["score"]))
            for i, found in got.items():
                assert found == [(j, float(s[i, j])) for j in sorted((j for j in range(150) if j != i), key=lambda j: (-s[i, j], j))[:5]]
