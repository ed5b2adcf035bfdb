"""From raw documents to packed training sequences: five stages, each a Parquet table that the next one reads.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns of docs beyond these are dropped, whatever their names; an empty table gives an empty one. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievery.llm import line_crf, mixing, near_dedup, packing, secrets_scan
from sievery.llm.common import documents, labels, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line classifier, learned from `labels` and these documents, scores below 0.3.

    Rows are judged one by one, repeated ones alike; a null or empty text has the score of one empty line. Null ids are
    never learned from. Without labels of both kinds every score is 0.5 and all rows stay."""
    model = line_crf.learn(docs, labels(spark, sf_dir))
    return line_crf.score_quality(docs, model, COLUMNS).where("score >= 0.3").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: of the least id, null last, then of the least text hash.

    Null and empty texts are in no component and stay; of rows with one id and equal texts one stays."""
    return near_dedup.deduplicated(docs.select(COLUMNS)).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces confirmed secrets in the texts; every document stays, n_chars follows the new text.

    A null text stays null with its n_chars; a null source counts as an ordinary path; repeated rows are redacted alike."""
    marked = secrets_scan.redacted(docs.select(COLUMNS), secrets_scan.trained(spark))
    return marked.withColumn("n_chars", F.when(F.col("_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target weight: a document is repeated as often as the mix takes it, none to two times.

    A null or empty text has no words and is not weighed; a null source is a source of its own, last in order. Equal
    ids and sizes are ordered by the texts' hashes, so that reruns agree; equal rows count each for itself."""
    mix = mixing.mixed(docs.select(COLUMNS)).where("_copies > 0")
    return mix.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens; a null or empty text is one piece of the end token. Repeated documents are packed each for itself."""
    packed = packing.packed_documents(docs)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mixing", mixture),
    ("packing", pack),
]
#: Similarity components and learned models have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
