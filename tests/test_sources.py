"""Matrix files against NumPy, and the JSON lines sink over failures."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievery.sources import lines, matrices


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(matrices.MatrixSource)
    spark.dataSource.register(lines.JsonLines)
    return spark


def tensors(path, arrays):
    names = {"f4": "F32", "f8": "F64", "f2": "F16", "i8": "I64"}
    header, at = {"__metadata__": {"by": "test"}}, 0
    for name, a in arrays.items():
        header[name] = {"dtype": names[a.dtype.str[1:]], "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    text = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + b"".join(a.tobytes() for a in arrays.values()))


def got(spark, path, **options):
    rows = spark.read.format("matrix").options(**options).load(str(path)).orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(len(rows)))
    return np.array([r["vector"] for r in rows])


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<f2", "<i8"])
def test_each_format_is_numpy(sources, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(matrices, "BLOCK", 100)
    r = np.random.default_rng(1)
    a, b = (r.normal(size=s) * 9 for s in ((57, 5), (31, 3)))
    a, b = a.astype(kind), b.astype(kind)
    np.save(tmp_path / "rows.npy", a)
    np.save(tmp_path / "cols.npy", np.asfortranarray(a))
    np.save(tmp_path / "flat.npy", a[:, 0])
    np.savez(tmp_path / "plain.npz", vectors=a, other=b)
    np.savez_compressed(tmp_path / "packed.npz", vectors=a, other=b)
    tensors(tmp_path / "t.safetensors", {"other": b, "vectors": a})
    for name in ("rows.npy", "cols.npy", "plain.npz", "packed.npz", "t.safetensors"):
        for rows in ("7", "1000"):
            assert np.array_equal(got(sources, tmp_path / name, member="vectors", rows=rows, double="true"), a.astype(np.float64)), name
        some = got(sources, tmp_path / name, member="vectors", rows="10", columns="3:5,0", double="true")
        assert np.array_equal(some, a[:, [3, 4, 0]].astype(np.float64)), name
    assert np.array_equal(got(sources, tmp_path / "flat.npy", double="true")[:, 0], a[:, 0].astype(np.float64))
    assert np.array_equal(got(sources, tmp_path / "plain.npz", double="true"), b.astype(np.float64))  # the first by name


def test_one_file_is_many_tasks_that_read_their_own_rows(sources, tmp_path):
    a = np.arange(4000, dtype=np.float32).reshape(1000, 4)
    np.save(tmp_path / "a.npy", a)
    parts = matrices.MatrixReader({"path": str(tmp_path / "a.npy"), "rows": "300"}, False).partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 300), (300, 600), (600, 900), (900, 1000)]
    assert sources.read.format("matrix").option("rows", "300").load(str(tmp_path / "a.npy")).rdd.getNumPartitions() == 4
    with open(tmp_path / "a.npy", "r+b") as f:  # a cut file still gives its first rows
        f.truncate(parts[0].matrix.at + 16 * 600)
    assert len(list(matrices.rows_of(parts[1].matrix, 300, 600, None))[0]) == 300


def test_a_folder_is_numbered_on(sources, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"{k}.npy", np.full((2 + k, 2), k, np.float32))
    (tmp_path / "note.txt").write_text("not a matrix")
    assert got(sources, "file://" + str(tmp_path), rows="2")[:, 0].tolist() == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    os.mkdir(tmp_path / "none")
    assert sources.read.format("matrix").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="objects"):
        np.save(tmp_path / "o.npy", np.array([{}], object))
        matrices.found(str(tmp_path / "o.npy"), None)


def read_lines(folder):
    return sorted(json.loads(x)["id"] for p in folder.glob("part-*.jsonl") for x in p.read_text().splitlines())


def test_lines_appear_at_once(sources, tmp_path):
    folder = tmp_path / "out"
    rows = sources.range(100).select("id", (F.col("id") % 3).alias("kind"), F.lit("é\n").alias("text")).repartition(4)
    rows.write.format("jsonl").mode("append").option("counters", "kind").save(str(folder))
    assert read_lines(folder) == list(range(100)) and lines.stats_of(str(folder))["counts"] == {"kind": {"0": 34, "1": 33, "2": 33}}
    broken = sources.range(100, 200, 1, 4).select("id", (F.col("id") % 3).alias("kind"), F.when(F.col("id") == 170, F.raise_error(F.lit("broken row"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("jsonl").mode("append").option("counters", "kind").save(str(folder))
    assert read_lines(folder) == list(range(100)) and not list(folder.glob("_*"))
    sources.range(200, 230).select("id", F.lit(0).alias("kind"), F.lit("").alias("text")).write.format("jsonl").mode("append").option("counters", "kind").save(str(folder))
    stats = lines.stats_of(str(folder))
    assert stats["rows"] == 130 == len(read_lines(folder)) and stats["counts"]["kind"]["0"] == 64 and sorted(stats["files"]) == sorted(p.name for p in folder.glob("part-*"))
    sources.range(5).select("id").write.format("jsonl").mode("overwrite").save(str(folder))
    assert read_lines(folder) == [0, 1, 2, 3, 4] and lines.stats_of(str(folder))["rows"] == 5


def test_a_file_is_replaced_whole(tmp_path):
    for text in ("one", "two"):
        lines.replaced(str(tmp_path), "a.json", text)
        assert (tmp_path / "a.json").read_text() == text and len(list(tmp_path.iterdir())) == 1
