"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents, longest first, each expect target / size copies. Their running sum plus one random offset of
the source crosses an integer as often as the document is taken. All documents of a source expect the same number of
copies, so the running sum is that number times the rank. Ranks come from counts of (source, size, hash bin), so that
no task holds a source: the counts' running sums give each bin's first rank, a window within the bin gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target: `share` of all sizes by the sources' weights, at most `most` times a source's size.

    Sources in code-point order, null last, take the weights in turn. What lies above the ceilings is shared among the
    others by weight until none is above: in ascending order of ceiling over weight, the first source whose share of
    what is left is not above its ceiling fixes the level. The windows hold one row for each source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ordered = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("ceiling", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = ordered.withColumn("level", level).withColumn("seat", F.row_number().over(by_ratio))
    fixed = F.min(F.when(F.col("level") * F.col("w") <= F.col("ceiling"), F.struct("seat", F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("ceiling"), F.coalesce(F.col("fixed") * F.col("w"), F.col("ceiling")))
    return levels.withColumn("fixed", fixed).select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text") -> DataFrame:
    """docs with _size (words), _source_size, _target and _copies (how often the mix takes the row, 0 upwards).

    A null text has size 0, a null source is a source of its own, rows with null or repeated ids count each for
    itself; rows of one id and size are ordered by their texts' hashes, if docs has the texts, so reruns agree. No row is
    taken more than ceil(target / source size) times. The same seed gives the same mix. Columns of docs with the names
    above are replaced. An empty table gives an empty result. docs is read twice: for the counts and for the result.
    What a task holds of all sources is a row a source."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    bin_of = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 3)
    made = ("_size", "_source_size", "_target", "_copies")
    text_hash = F.xxhash64(text_col) if text_col in docs.columns else F.lit(0).cast("long")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made], F.lit(0).alias("_none"))
    rows = docs.select(kept.alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), text_hash.alias("_hash"), (n_words(F.col(text_col)) if size is None else size).alias("_size"), key.alias("_key"), bin_of.alias("_bin"))
    bins = written(rows.groupBy("_key", "_size", "_bin").agg(F.count("*").alias("n")), "bins")
    groups = bins.groupBy("_key", "_size").agg(F.sum("n").alias("n"))
    sizes = groups.groupBy("_key").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    named = sizes.withColumn("source", F.when(F.col("_key") != "n", F.substring("_key", 2, 1 << 30)))
    aims = targets(named.select("source", "source_size"), share, most).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    longest = Window.partitionBy("_key").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_key", "_size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("_key", "_size", F.coalesce(F.sum("n").over(longest), F.lit(0)).alias("_first"))
    within = bins.select("_key", "_size", "_bin", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_more"))
    start = within.join(first, ["_key", "_size"]).join(aims, "_key").select("_key", "_size", "_bin", (F.col("_first") + F.col("_more")).alias("_start"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_key", "_size", "_bin").orderBy("_id", "_hash"))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("_source"), seed)
    crossed = F.floor(u + F.col("_each") * F.col("_rank")) - F.floor(u + F.col("_each") * (F.col("_rank") - 1))
    placed = rows.join(start, ["_key", "_size", "_bin"]).withColumns({"_rank": rank, "_each": each})
    copies = F.least(crossed, F.ceil("_each")).cast("long")
    return placed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in made], "_size", "_source_size", "_target", copies.alias("_copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; sizes are counted once, into a small stored table."""
    sized = written(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("words")), "sizes")
    mix = mixed(sized, size=F.col("words"))
    return mix.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS ceiling,
    1.5::DOUBLE * sum(source_size) OVER () AS everything
  FROM totals
), levels AS (
  SELECT *, row_number() OVER (ORDER BY ceiling / w, source NULLS LAST) AS seat, (everything - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), aims AS (
  SELECT source, source_size, least(ceiling, coalesce((SELECT arg_min(level, seat) FROM levels WHERE level * w <= ceiling) * w, ceiling)) AS target FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS each,
    ('0x' || substr(md5('1|' || coalesce(s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 3), s.doc_id NULLS FIRST) AS rank
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, (size * least(floor(u + each * rank) - floor(u + each * (rank - 1)), ceil(each)))::BIGINT AS taken FROM ranked
"""
