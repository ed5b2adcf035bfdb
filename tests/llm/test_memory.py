"""Memory of the kernels is bounded by slices, not by how many rows a batch holds; clashing names; pipeline stages on odd rows."""

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sievery.llm import mixing, near_dedup, secrets_scan
from sievery.llm.common import documents, resident, slices

PEAK = """
import resource, sys
from sievery.llm import line_crf, near_dedup, language_id
from sievery.llm.common import slices
import numpy as np, pyarrow as pa
text = ("some words of a line here and there\\n" * 5600)[:200_000]
batch = pa.record_batch([pa.array(range(500)), pa.array([text + str(i) for i in range(500)])], names=["id", "text"])
model = {"mean": np.zeros(12), "spread": np.ones(12), "weight": np.ones((36, 2)), "move": np.zeros((2, 2)), "a": 1.0, "b": 0.0}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for part in slices(batch, 1):
    line_crf.scores(model, part.column(1).to_pylist())
    near_dedup.shingle_sets(part.column(1).to_pylist())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""

def test_500_long_texts_take_little_memory():
    out = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, timeout=600, check=True)
    assert int(out.stdout) < 250  # MB, beside 100 MB of texts

def test_slices_hold_every_row_once():
    texts = ["a" * 10, None, "b" * 5000, "", "c" * 100] * 50
    batch = pa.record_batch([pa.array(range(250)), pa.array(texts)], names=["id", "text"])
    parts = list(slices(batch, 1, 300, 20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(250)) and max(p.num_rows for p in parts) <= 20
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 300 or p.num_rows == 1 for p in parts)

def test_one_model_stays():
    made = []
    make = lambda k: lambda: made.append(k) or k
    assert [resident(("x", k), make(k)) for k in (1, 1, 2, 1)] == [1, 1, 2, 1] and made == [1, 2, 1]

def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "s", 5, "k", 7), (1, "plain words here", "s", 6, "l", 8)], "doc_id long, text string, source string, _copies int, _secrets string, _size int")
    mix = mixing.mixed(docs)
    assert sorted(mix.columns) == sorted(["doc_id", "text", "source", "_secrets", "_size", "_source_size", "_target", "_copies"]) and mix.count() == 2
    red = secrets_scan.redacted(docs, secrets_scan.trained(spark))
    assert red.columns == docs.columns and sorted(r["_secrets"] for r in red.collect()) == [0, 1]
    assert near_dedup.deduplicated(docs).columns == docs.columns

@pytest.mark.parametrize("folder", ["odd_dir", "empty_dir"])
def test_stages_on_odd_rows(spark, request, folder):
    path = request.getfixturevalue(folder)
    docs = documents(spark, path)
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == cp.COLUMNS
        if name in ("quality classifier", "secret scans"):
            assert out.count() <= n
        if name == "secret scans":
            assert out.count() == n and out.where(F.col("text").isNull()).count() == docs.where(F.col("text").isNull()).count()
    assert cp.run(spark, path).count() >= 0

