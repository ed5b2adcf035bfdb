from collections import defaultdict

import duckdb

from sievery.llm import licenses, mixing
from sievery.llm.registry import ORACLES, QUERIES

from .conftest import SF


def same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want) and want


def test_mixing_matches_sql(spark):
    same(spark, "op8_mixing")


def test_licenses_match_sql(spark):
    same(spark, "op1_license_scans")


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), "abc"[i % 7 % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(docs).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[r["source"]] += r["_size"] * r["_copies"]
        target[r["source"]], size[r["source"]] = r["_target"], r["_source_size"]
        assert 0 <= r["_copies"] <= 2
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size)
    again = {r["doc_id"]: r["_copies"] for r in mixing.mixed(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["_copies"] for r in got}


def test_altered_notice_and_full_text(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    texts = ["Released under the the MIT License!", "released under the terms of some other agreement", f"intro\n\n{mit[:150]}\n{mit[150:]}\n\nend", "nothing to see"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["unit"], r["license"]) for r in licenses.scan_licenses(docs).collect()}
    assert (0, "line", "MIT") in got and (2, "paragraph", "MIT") in got and not any(i in (1, 3) for i, *_ in got)
