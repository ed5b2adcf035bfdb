"""Chunks that are computed once, results by id, lookups that prune the scan, and entity spans against a loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.operators import chunks, spans


def test_only_changed_chunks_are_computed(spark, tmp_path):
    """A run that dies in its third job keeps the first two; a changed, a new and a deleted row touch their chunks alone."""
    rows, store, asked = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text")), str(tmp_path / "store"), []

    def compute(part, dies_at=None):
        def used(df):
            asked.append(df)
            out = df.select("id", F.upper("text").alias("big"))
            return out.withColumn("big", F.when(F.lit(len(asked) == dies_at), F.raise_error(F.lit("killed"))).otherwise(F.col("big"))) if dies_at else out

        return used(part)

    def run(df, dies_at=None, label=""):
        asked.clear()
        out = chunks.resumed(df, "id", ["text"], lambda d: compute(d, dies_at), store, chunks=16, wave=4, label=label)
        return out, len(asked) - 1  # the first call is for the schema

    with pytest.raises(Exception, match="killed"):
        run(rows, dies_at=4)
    out, jobs = run(rows)
    assert jobs == 2 and sorted((r["id"], r["big"]) for r in out.collect()) == [(i, f"T{i}") for i in range(500)]
    assert run(rows.repartition(7))[1] == 0
    changed = rows.where("id <> 9").withColumn("text", F.when(F.col("id") == 5, "new").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(900, "t900")], "id long, text string"))
    before = {r["chunk"]: r["print"] for r in chunks.fingerprints(rows, "id", ["text"], 16).collect()}
    after = {r["chunk"]: r["print"] for r in chunks.fingerprints(changed, "id", ["text"], 16).collect()}
    touched = {r[0] for r in spark.createDataFrame([(5,), (9,), (900,)], "id long").select(chunks.chunk_of(F.col("id"), 16)).collect()}
    assert {c for c in after if after[c] != before[c]} == touched
    out, jobs = run(changed)
    assert jobs == 1 and sorted((r["id"], r["big"]) for r in out.collect()) == sorted([(i, f"T{i}") for i in range(500) if i not in (5, 9)] + [(5, "NEW"), (900, "T900")])
    assert asked[-1].select(chunks.chunk_of(F.col("id"), 16).alias("c")).distinct().count() == len(touched)
    assert run(changed, label="v2")[1] == 4
    assert run(rows.limit(0))[0].count() == 0


def test_results_by_id_are_computed_once(spark, tmp_path):
    asked = []

    def compute(ids):
        asked.append(ids)
        return ids.select("id", (F.col("id") * 2).alias("twice"))

    path = str(tmp_path / "cache")
    for want in ([1, 2, 2, None], [2, 1], [2, 3]):
        got = chunks.remembered(spark.createDataFrame([(i,) for i in want], "id long"), "id", compute, path)
        assert sorted(map(tuple, got.collect())) == sorted({(i, 2 * i) for i in want if i})
    assert len(asked) == 5  # once a call for the schema, and for [1, 2] and [3]


def test_lookups_prune_the_scan(spark, tmp_path):
    """Row groups and files without a wanted key aren't read; unknown and null keys are kept."""
    path = str(tmp_path / "items")
    spark.range(0, 20_000, 1, 20).select("id", F.concat(F.lit("n"), "id").alias("name")).write.parquet(path)
    rows = spark.read.parquet(path)
    wanted = spark.createDataFrame([(7, 1), (7, 2), (19_990, 3), (-5, 4), (None, 5), (10**9, 6)], "id long, at int")
    out = chunks.looked_up(wanted, rows, "id", "name")
    assert sorted((r["at"], r["name"]) for r in out.collect()) == [(1, "n7"), (2, "n7"), (3, "n19990"), (4, ""), (5, ""), (6, "")]
    names = [7, 19_990, -5, 10**9]
    scanned = rows.where(chunks.within(F.col("id"), names))
    scanned.collect()
    plan = scanned._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(id" in plan.toString()
    leaf = plan.collectLeaves().apply(0)
    assert leaf.metrics().get("numOutputRows").get().value() <= 2000  # two of twenty files hold a wanted key
    assert sorted((r["at"], r["name"]) for r in chunks.looked_up(wanted, rows, "id", "name", most=2).collect())[0] == (1, "n7")
    assert {r["name"] for r in chunks.looked_up(wanted, rows.limit(0), "id", "name").collect()} == {""}


def brute_spans(low, vocabulary):
    hits = []
    for kind, terms in vocabulary.items():
        for term in terms:
            hits += [(-len(term), m.start(), m.end(), kind, term) for m in re.finditer(r"(?<!\w)(?=" + re.escape(term) + r"(?!\w))", low) for m in [re.compile(re.escape(term)).match(low, m.start())]]
    taken, out = set(), []
    first = {t: k for k, terms in reversed(vocabulary.items()) for t in terms}
    for _, a, b, kind, term in sorted(hits):
        if first[term] == kind and not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.append((kind, term, a, b))
    return sorted(out, key=lambda s: s[2])


def test_spans_and_tags(spark):
    """Nested, repeated and touching terms, terms of two types, letters beyond ASCII, nulls."""
    vocabulary = {"phrase": ["red red", "deep red", "été"], "colour": ["red", "deep", "blue-green"], "thing": ["ring", "red", "ring box"]}
    r = random.Random(2)
    words = ["red", "Red", "deep", "ring", "ring box", "box", "rings", "blue-green", "blue", "été", "İstanbul", "red_", "x"]
    texts = [None, "", "redred", *["".join(r.choice(words) + r.choice([" ", " ", ", ", "-", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = spans.with_tags(spans.with_spans(rows, vocabulary)).collect()
    for row in got:
        text = row["text"] or ""
        found = [(s["type"], s["term"], s["start"], s["end"]) for s in row["spans"]]
        plain = spans.lowered(text)
        assert found == brute_spans(plain, vocabulary), text
        assert all(plain[a:b] == term for _, term, a, b in found)
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        assert row["tokens"] == text.split() and len(row["tags"]) == len(tokens)
        for (a, b), tag in zip(tokens, row["tags"], strict=True):
            touching = [f for f in found if f[2] < b and f[3] > a]
            assert (tag == "O") == (not touching)
            if touching and tag[0] == "B":
                assert tag == "B-" + touching[0][0]
    stats = {x["type"]: x for x in spans.type_stats(spans.with_spans(rows, vocabulary)).collect()}
    assert stats["phrase"]["n"] == sum(s["type"] == "phrase" for row in got for s in row["spans"])
    assert stats["thing"]["n_rows"] == sum(any(s["type"] == "thing" for s in row["spans"]) for row in got)
    assert spans.with_spans(rows, {}).where(F.size("spans") > 0).count() == 0


def test_keywords_and_templates(spark):
    rows = spark.createDataFrame([(1, "Faux Leather off-white don't"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: r for r in rows.select("id", tx.keywords(F.col("t"), ["off-white", "leather", "faux leather", "white"]).alias("k"), tx.first_class(F.col("t"), [("a", ["leather"]), ("b", ["faux", "leather"])]).alias("c"), tx.tokens_with_clitics(F.col("t")).alias("w")).collect()}
    assert got[1]["k"] == ["faux leather", "leather", "off-white"] and tuple(got[1]["c"]) == ("b", "faux") and got[1]["w"][-1] == "don't"
    assert tuple(got[3]["c"]) == ("other", "general") and got[3]["k"] == []
    texts = [r[0] for r in spark.range(400).select(tx.filled_template("{a}-{a} {b}!", {"a": ["x", "y"], "b": ["1", "2", "3"]}, "s", F.col("id"))).collect()]
    assert set(texts) == {f"{a}-{c} {b}!" for a in "xy" for c in "xy" for b in "123"}
