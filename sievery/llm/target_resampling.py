"""Importance resampling of documents towards a target distribution, over hashed runs of one to three words.

DuckDB works within each partition: SQL unnests the words of a slice of texts, windows make the runs, a registered
function gives zlib's CRC of each distinct word, another joins the CRCs of a run's words to that of the run. Each task
gives the counts of buckets of every text and, at its end, of all its texts; Spark spills both to Parquet, merges the
tasks' sums, scores the texts by the buckets' gains and ranks them with Gumbel noise.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mapped, slices, written

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Bytes of text that one SQL statement reads, and what DuckDB may hold before it spills to the task's temporary folder.
STEP, MEMORY = 2 << 20, "300MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def appended_zeros() -> list[np.ndarray]:
    """For each k tables (4 x 256) of what 2^k zero bytes make of a CRC; the step for one comes from zlib."""
    places = np.arange(256, dtype=np.int64)[None, :] << (8 * np.arange(4))[:, None]
    none = zlib.crc32(b"\0", 0)
    tables = [np.array([[zlib.crc32(b"\0", int(x)) ^ none for x in row] for row in places], np.int64)]
    for _ in range(31):
        tables.append(shifted(tables[-1], shifted(tables[-1], places)))
    return tables


def shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def joined(zeros: list[np.ndarray], first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs of texts of which a first part has one CRC and the rest, of so many bytes, the other."""
    for k in range(int(length.max(initial=0)).bit_length()):
        first = np.where(length >> k & 1, shifted(zeros[k], first), first)
    return first ^ second


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    """A connection with crc32(text) and crc32_join(crc, crc, bytes); it spills to the folder."""
    con, zeros = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder}), appended_zeros()

    def column(x: pa.Array | pa.ChunkedArray) -> pa.Array:
        return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

    def crc32(text):
        return pa.array([zlib.crc32(t) for t in column(text).cast(pa.binary()).to_pylist()], pa.int64())

    def crc32_join(first, second, length):
        # where a run has no further word all three are null and so is the result
        ones = [column(x) for x in (first, second, length)]
        a, b, n = (x.fill_null(0).to_numpy() for x in ones)
        return pa.array(joined(zeros, a, b, n), mask=ones[2].is_null().to_numpy(zero_copy_only=False))

    con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    con.create_function("crc32_join", crc32_join, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow", null_handling="special")
    return con


def runs_sql(buckets: int, longest: int) -> list[str]:
    """The statements for a registered slice `part` (line, text): the counts of its buckets as a table, and their sums added up."""
    names = [f"c{k}" for k in range(longest)]
    leads = "".join(f", lead(tail, {k}) OVER w AS t{k}, lead(bytes, {k}) OVER w AS b{k}" for k in range(1, longest))
    chain = "".join(f", chain{k} AS (SELECT *, crc32_join(c{k - 1}, t{k}, b{k}) AS c{k} FROM chain{k - 1})" for k in range(1, longest))
    return [
        f"""CREATE OR REPLACE TEMP TABLE words AS SELECT line, unnest(found) AS word, generate_subscripts(found, 1) AS nth
            FROM (SELECT line, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS found FROM part)""",
        f"""CREATE OR REPLACE TEMP TABLE counted AS
            WITH known AS (SELECT word, crc32(word) AS c0, crc32(' ' || word) AS tail, strlen(word) + 1 AS bytes FROM (SELECT DISTINCT word FROM words)),
            chain0 AS (SELECT line, c0{leads} FROM words JOIN known USING (word) WINDOW w AS (PARTITION BY line ORDER BY nth)){chain},
            runs AS (SELECT line, unnest([{", ".join(names)}]) % {buckets} AS bucket FROM chain{longest - 1})
            SELECT line, bucket, count(*) AS n FROM runs WHERE bucket IS NOT NULL GROUP BY line, bucket""",
        "INSERT INTO totals SELECT bucket, sum(n) FROM counted GROUP BY bucket",
    ]


PER_TEXT = """SELECT line, w.n AS n_words, f.n AS n_features, buckets, counts
FROM (SELECT line, count(*) AS n FROM words GROUP BY line) w
JOIN (SELECT line, sum(n)::BIGINT AS n, list(bucket::SMALLINT) AS buckets, list(n::INTEGER) AS counts FROM counted GROUP BY line) f USING (line) ORDER BY line"""


def spilled(texts: DataFrame, name: str, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table: for each text id, n_words, n_features, buckets and counts (of its distinct buckets), and for each task a row with totals.

    A null text has no words. A task holds a slice of texts or one text; DuckDB spills what takes more than MEMORY."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="runs-") as folder:
            con, kinds, statements = connected(folder), None, runs_sql(buckets, longest)
            con.execute("CREATE TABLE totals (bucket BIGINT, n BIGINT)")
            for batch in batches:
                kinds = batch.schema.field(0).type
                for part in slices(batch, 1, STEP, 20_000):
                    lines = pa.array(np.arange(part.num_rows))
                    con.register("part", pa.table({"line": lines, "text": part.column(1)}))
                    for statement in statements:
                        con.execute(statement)
                    con.execute("CREATE OR REPLACE TABLE totals AS SELECT bucket, sum(n)::BIGINT AS n FROM totals GROUP BY bucket")
                    yield per_text(part, con.sql(PER_TEXT).to_arrow_table())
                    con.unregister("part")
            if kinds is not None:
                sums = np.zeros(buckets, np.int64)
                for b, n in con.execute("SELECT bucket, n FROM totals").fetchall():
                    sums[b] = n
                nothing = [pa.nulls(1, kind) for kind in (kinds, pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([sums], pa.list_(pa.int64()))], NAMES)
            con.close()

    key = F.col(id_col) if id_col else F.lit(0).cast("long")
    rows = texts.select(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(mapped(rows, each, f"id {kind}, n_words long, n_features long, buckets array<smallint>, counts array<int>, totals array<long>"), name)


NAMES = ["id", "n_words", "n_features", "buckets", "counts", "totals"]


def per_text(part: pa.RecordBatch, found: pa.Table) -> pa.RecordBatch:
    """The found counts in the order of the slice's rows; texts without words have none."""
    at = np.full(part.num_rows, -1)
    at[found["line"].to_numpy()] = np.arange(len(found))
    take = pa.array(at, mask=at < 0)
    of = lambda name, kind: found[name].combine_chunks().cast(kind).take(take)
    numbers = [of(name, pa.int64()).fill_null(0) for name in ("n_words", "n_features")]
    lists = [of(name, pa.list_(kind)) for name, kind in (("buckets", pa.int16()), ("counts", pa.int32()))]
    return pa.RecordBatch.from_arrays([part.column(0), *numbers, *lists, pa.nulls(part.num_rows, pa.list_(pa.int64()))], NAMES)


def merged(spill: DataFrame, buckets: int) -> list[int]:
    """How many runs fell into each bucket: the tasks' sums, added up by Spark; `buckets` rows come to the driver."""
    each = spill.where("totals IS NOT NULL").select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = dict(each.collect())
    return [counts.get(b, 0) for b in range(buckets)]


def gains(raw: list[int], target: list[int]) -> list[int]:
    """1000 times the log ratio of the target's smoothed share of each bucket to the corpus's, rounded down."""
    s, t, b = float(sum(raw)), float(sum(target)), len(raw)
    return [math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(raw, target, strict=True)]


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_features, weight, score, rank (null unless drawn).

    Of the N rows with least_words words or more, floor(percent * N / 100) are drawn by the highest score, ties to the
    lesser id, null ids last, then by weight and features; equal rows take ranks of their own. A null or empty text has no
    features, weight 0, and is not drawn where least_words is above 0. A null id's noise is that of an empty one. Other
    columns are dropped, whatever their names; an empty table gives an empty result, an empty target smoothed gains alone.

    The texts are read once. Stored: bucket counts of each text, then five numbers of each, then the rows near enough to
    the top to be drawn, sorted by ranges with their places, so that no task holds a whole order."""
    spill = spilled(docs, "bucket-counts", buckets, longest, id_col, text_col)
    table = gains(merged(spill, buckets), merged(spilled(target, "target-counts", buckets, longest, None, text_col), buckets))
    of = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one constant
    products = F.zip_with("buckets", "counts", lambda b, n: F.get(of, b.cast("int")) * n)
    weight = F.coalesce(F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = spill.where("totals IS NULL").select("id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))
    scored = written(scored, "scored")
    return placed(scored, percent, least_words).withColumnRenamed("id", id_col)


def placed(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The stored rows with their ranks. An approximate quantile, whose error is bounded, tells the rows that may be drawn."""
    able = F.col("n_words") >= least_words
    share = max(0.0, 1 - percent / 100 - 0.002)
    total, cut = scored.where(able).agg(F.count("*"), F.percentile_approx("score", share, 10_000)).first()
    drawn = percent * total // 100
    columns = ["id", "n_features", "weight", "score"]
    near = able & (F.col("score") >= F.lit(cut)) if drawn else F.lit(False)
    rest = scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not drawn:
        return rest
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.desc("weight"), F.desc("n_features")]
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = scored.where(near).select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranges = written(ranges.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at") + 1
    ranked = ranges.join(F.broadcast(before), "_part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))  # a row a range
    return rest.unionByName(ranked)


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the texts of benchmark; 5 of 100 are drawn."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampled(documents(spark, sf_dir), target)
