import random
import re

import numpy as np
from pyspark.sql import functions as F

from sievery.llm import near_dedup as nd
from sievery.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def variants():
    """A large group of near copies of differing similarity, passages that many texts share, copies and short texts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    out = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(40):
        out.append(" ".join([*passage, *[word() for _ in range(r.randint(5, 80))]]))
    out += ["Same Text here", "same text HERE", "same text here too", "one two three four five", "one two three four five six", "a b c d e f g h", "a b c d e f g i", "", None] + [out[0].upper()] * 3
    return list(enumerate(out))


def test_components_match_brute_force(spark):
    docs = variants()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert got == brute(docs)
    kept = sorted(r["doc_id"] for r in nd.deduplicated(df).collect())
    assert kept == sorted(i for i, (_, c) in got.items() if i == c)


def test_repeated_and_null_ids_lose_no_text(spark):
    r = random.Random(8)
    text = lambda: [("w%d" % r.randrange(10**6)) for _ in range(60)]
    a, b, c, d, e = text(), text(), text(), text(), text()
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [
        (3, near(a, 0)), (5, near(a, 1)), (5, near(b, 0)),  # id 5: a near copy of 3, and a text of its own
        (None, near(c, 0)), (None, near(c, 1)), (None, near(c, 1)), (None, near(d, 0)),  # null ids: three near copies, and a text of its own
        (7, near(e, 0)), (7, near(e, 1)), (8, near(e, 2)), (None, near(e, 3)), (9, ""), (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], x["text"]) for x in nd.deduplicated(df).collect()]
    assert set(got) <= set(rows) and len(set(got)) == len(got)
    assert [sum(bool(t) and t.startswith(w[0] + " ") for _, t in got) for w in (a, b, c, d, e)] == [1] * 5
    assert {i for i, t in got if t and t.startswith(e[0] + " ")} == {7}
    assert (3, rows[0][1]) in got and (5, rows[2][1]) in got and (9, "") in got and (None, None) in got


def test_crowded_buckets_match_brute_force(spark, monkeypatch):
    """With buckets of a few classes counted as crowded, the finer ones find the same components."""
    monkeypatch.setattr(nd, "CROWD", 8)
    docs = variants()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df, stars=1).collect()}
    assert got == brute(docs)


def test_texts_that_share_a_passage_do_not_all_meet(spark):
    """20,000 texts with one passage and three near copies among them: finer buckets are few, as the passage is in none."""
    r = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *[f"w{r.randrange(10**9)}" for _ in range(50)]]) for _ in range(20_000)]
    for k in (1, 2):
        texts[k] = texts[0].rsplit(" ", 2)[0] + f" end{k} of{k}"
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = nd.near_duplicates(df).where("NOT kept").collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 0), (2, 0)]
    sets = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(nd.shingle_sets(texts))], "node long, members binary")
    assert nd.rarest(sets, 75).count() < 200


def test_rarest_shingles_lose_no_pair(spark):
    docs = [t for _, t in variants() if t]
    sets = nd.shingle_sets(docs)
    found = {}
    for x in nd.rarest(spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, members binary"), 75).collect():
        found.setdefault(x["key"], set()).add(x["node"])
    met = {(a, b) for nodes in found.values() for a in nodes for b in nodes if a < b}
    close = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert close <= met and close


def test_blocks_find_every_pair(spark):
    """Ranges of places cover all pairs of different components, whatever the block size."""
    sets = nd.shingle_sets([t for _, t in variants()[:60]])
    rows = [(1, 0, 0, i, i % 3, len(s), nd.marks(s).tobytes(), nd.registers(s).tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, band int, bands long, node long, comp long, n long, marks binary, registers binary")
    whole = {(r["a"], r["b"]) for r in nd.across(df, 75, 0, 1 << 62).collect()}
    parts = [{(r["a"], r["b"]) for r in nd.across(df, 75, a, b, block=13).collect()} for a, b in ((0, 2), (2, 1 << 62))]
    assert parts[0] | parts[1] == whole and whole
    close = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert close <= whole


def test_similarity_is_estimated_well():
    r = np.random.default_rng(2)
    for n in (40, 400, 4000):
        common, a, b = (np.unique(r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)) for k in (n * 6, n, n))
        x, y = np.union1d(common, a), np.union1d(common, b)
        p, q = nd.registers(x), nd.registers(y)
        assert abs((p == q).mean() - 0.75) < 0.2
        u, v = nd.marks(x), nd.marks(y)
        args = ((u == v).sum(), (u > 0).sum(), (v > 0).sum(), ((u > 0) & (v > 0)).sum(), len(x), len(y))
        assert nd.similar(*args, 75)


def test_components_of_contracted_edges(spark):
    """A long chain, stars and random links, contracted a few at a time and in one go."""
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(r.randrange(200, 400), r.randrange(400, 500)) for _ in range(90)]
    least = {n: n for e in edges for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {(x["node"], x["comp"]) for x in nd.components(df).collect()} == set(least.items())
    some = nd.starred(df, most=4).collect()
    assert all(x["a"] < x["b"] and least[x["a"]] == least[x["b"]] for x in some)
    assert nd.starred(df.limit(0)).isEmpty() and nd.components(df.limit(0)).isEmpty()


def test_slots_of_finer_buckets_lose_no_pair(spark):
    """Texts that share many finer buckets: leaving pairs to their least bucket finds the same ones."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[: 120 - r.randint(0, 3)], *[f"x{r.randrange(10**6)}" for _ in range(3)]]) for _ in range(30)]
    sets = nd.shingle_sets(texts)
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, members binary")
    finer = written(nd.rarest(full, 75), "finer")
    marks = spark.createDataFrame([(i, i, len(s), nd.marks(s).tobytes()) for i, s in enumerate(sets)], "node long, comp long, n long, marks binary")
    keys = finer.join(nd.slotted(finer), "node").select("node", "key", F.lit(64).alias("band"), nd.below(F.col("slots"), F.col("key")).alias("bands"), "registers")
    rows = keys.join(marks, "node")
    once = {(x["a"], x["b"]) for x in nd.across(rows, 75, 0, 1 << 62).collect()}
    every = {(x["a"], x["b"]) for x in nd.across(rows.withColumns({"band": F.lit(0), "bands": F.lit(0).cast("long")}), 75, 0, 1 << 62).collect()}
    assert once == every and len(every) > 100
