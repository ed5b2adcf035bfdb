"""Resampling against a brute-force version with zlib, and its parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievery.llm import target_resampling as tr

from .conftest import SF


def buckets_of(text, buckets, longest=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent=5, least=20, buckets=10_000, longest=3, seed=42):
    each = [(d, *buckets_of(t, buckets, longest)) for d, t in docs]
    raw, aim = Counter(b for _, _, x in each for b in x), Counter(b for t in target for b in buckets_of(t, buckets, longest)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, x in each:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append((d, len(words), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(rows) - Counter(drawn)
    return sorted([(r[0], *r[2:], k + 1) for k, r in enumerate(drawn)] + [(r[0], *r[2:], None) for r in rest.elements()], key=repr)


def test_crc_of_joined_texts():
    zeros, r = tr.appended_zeros(), random.Random(1)
    a, b = ([bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 17, 400]))) for _ in range(200)] for _ in range(2))
    got = tr.joined(zeros, np.array([zlib.crc32(x) for x in a]), np.array([zlib.crc32(x) for x in b]), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_whole_table(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [x[0] for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = tr.op13_target_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


@pytest.mark.parametrize(("options", "step"), [({}, 2 << 20), ({"percent": 37, "buckets": 50, "longest": 2, "seed": 1}, 400), ({"percent": 100, "least_words": 0, "longest": 1}, 2 << 20), ({"percent": 0}, 2 << 20)])
def test_odd_texts(spark, monkeypatch, options, step):
    monkeypatch.setattr(tr, "STEP", step)
    r = random.Random(5)
    vocabulary = ["Der", "the", "x1", "Ünit", "日本", "o'clock", "e-mail", "\x00", "\u2028q", "A\tB", "😀", "ZZ", "İ", "k\x7fj"]
    rows = [(None if i % 9 == 4 else i // 2, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 30, 60])))) for i in range(150)]
    rows += [(7, None), (8, ""), (None, None), (9, "same words " * 20), (9, "same words " * 20), (9, "same words " * 20), (10, "long " * 60_000), (11, "w" * 100_000)]
    target = ["the x1 日本 the x1 日本", None, "", "Der the"]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rank int, score int").repartition(5)
    wanted = {k.replace("least_words", "least"): v for k, v in options.items()}
    got = tr.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, **wanted)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 30)], "doc_id long, text string")
    assert tr.resampled(none, some.select("text")).collect() == []
    assert sorted(map(tuple, tr.resampled(some, none.select("text"), percent=100).collect())) == brute([(1, "one two " * 30)], [], percent=100)
