"""Fill-in-the-middle against regular expressions and slices of strings, also with blocks and lanes of a few bytes."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievery.llm import fill_middle as fm

from .conftest import SF


def expected(doc_id, text, sentinels=fm.SENTINELS, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid


def made(r, letters, n):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize(("block", "lane"), [(16, 3), (64, 16), (256, 8), (1 << 20, 512)])
def test_scan_in_lanes_and_blocks(monkeypatch, block, lane):
    monkeypatch.setattr(fm, "BLOCK", block)
    monkeypatch.setattr(fm, "LANE", lane)
    r, table = random.Random(block), fm.Automaton(fm.SENTINELS)
    for _ in range(60):
        texts = [made(r, "ab<PSM>\n\né日😀", r.choice([0, 1, 5, 50, 400])) for _ in range(r.randint(1, 9))]
        edges = np.cumsum([0, *(len(t.encode()) for t in texts)])
        found = fm.Texts(table, np.frombuffer("".join(texts).encode(), np.uint8), edges)
        for k, t in enumerate(texts):
            units = re.findall(r"[^\n]*\n|[^\n]+", t)
            assert found.n[k] == len(units) and found.marked[k] == any(s in t for s in fm.SENTINELS)
            places = np.arange(len(units) + 1)
            byte, point = found.located(np.full(len(places), k), places)
            heads = ["".join(units[:c]) for c in places]
            assert (byte - edges[k]).tolist() == [len(h.encode()) for h in heads]
            assert (point - found.points[k]).tolist() == [len(h) for h in heads]


def test_rows_and_their_way_back(spark):
    r = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "one line", "<P>", "a<P", "<S\n>", "<M> x\ny", "<<M", *[made(r, "ab<PM>\n日😀 ", r.choice([3, 40, 900])) for _ in range(200)], "line\n" * 300_000, "é" * 2_000_000]
    rows = [(None if i % 50 == 7 else i, t, "x") for i, t in enumerate(texts)] + [(4, "one line", "y"), (4, "one\nline", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    for options in ({}, {"rate": 40, "spm": 80, "seed": 9}, {"sentinels": ("[[one]]", "[[two]]", "#")}):
        out = fm.transformed(docs, **options)
        back = fm.restored(F.col("output"), F.col("form"), options.get("sentinels", fm.SENTINELS))
        got = sorted((tuple(x) for x in out.withColumn("back", back).collect()), key=repr)
        assert got == sorted(((d, *expected(d, t, **options), t or "") for d, t, _ in rows), key=repr)


def test_sentinels_must_have_one_reading():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S>", ""), ("ab", "xaby", "z"), ("ab", "bc", "z"), ("<P>", "<S>")):
        with pytest.raises(ValueError, match="sentinels"):
            fm.checked(bad)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = fm.op11_fill_in_middle(spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({fm.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
