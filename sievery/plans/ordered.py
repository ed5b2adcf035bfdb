"""Batch forms of the scans whose result depends on the order of rows; streaming.stateful has the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievery.functions.text import word_count
from sievery.operators import profiling, retrieval, sampling

from .base import query, table

#: Buckets of the greedy quota and how many rows each takes.
TARGETS = {"view": 20, "click": 25, "purchase": 15, "high": 40, "low": 30}
LENGTHS = {"medium": 40, "long": 30}

GROUPS_SQL = """
WITH marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM marked)
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, round(sum(value), 4) AS total_value FROM runs GROUP BY user_id, run
"""


@query("keyed_flush", GROUPS_SQL)
def keyed_flush(spark, d):
    """Groups of consecutive events of one type of each user, as a keyed buffer gives them out."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    runs = profiling.runs_of_key(events, "event_type", "event_id", ("user_id",))
    sums = [F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.sum("value"), 4).alias("total_value")]
    return runs.groupBy("user_id", "run").agg(*sums)


def bucketed_events(events):
    """events with buckets: the type, and high or low by value; a type without a target is no obstacle."""
    return events.withColumn("buckets", F.filter(F.array("event_type", F.when(F.col("value") >= 30, "high").when(F.col("value") < 5, "low")), lambda b: b.isNotNull()))


GREEDY_SQL = """
WITH e AS (
  SELECT event_id, user_id, list_filter([event_type, CASE WHEN value >= 30 THEN 'high' WHEN value < 5 THEN 'low' END], lambda b: b IN ('view', 'click', 'purchase', 'high', 'low')) AS b FROM events
), steps AS (
  SELECT list({'id': event_id, 'u': user_id, 'b': b, 'room': MAP([]::VARCHAR[], []::INT[]), 'seen': []::BIGINT[], 'got': []::STRUCT(event_id BIGINT, needed VARCHAR[])[]} ORDER BY event_id) AS l FROM e WHERE len(b) > 0
), ended AS (
  SELECT list_reduce(l, lambda s, x: CASE WHEN list_contains(s.seen, x.u) OR len(list_filter(x.b, lambda k: s.room[k] > 0)) = 0 THEN s ELSE
    {'id': x.id, 'u': x.u, 'b': x.b,
     'room': map_from_entries(list_transform(map_entries(s.room), lambda r: {'key': r.key, 'value': r.value - (list_contains(x.b, r.key) AND r.value > 0)::INT})),
     'seen': list_append(s.seen, x.u),
     'got': list_append(s.got, {'event_id': x.id, 'needed': list_sort(list_filter(x.b, lambda k: s.room[k] > 0))})} END,
    {'id': 0::BIGINT, 'u': 0::BIGINT, 'b': []::VARCHAR[], 'room': MAP(['view', 'click', 'purchase', 'high', 'low'], [20, 25, 15, 40, 30]), 'seen': []::BIGINT[], 'got': []::STRUCT(event_id BIGINT, needed VARCHAR[])[]}).got AS got
  FROM steps
)
SELECT e.event_id, e.user_id, array_to_string(g.needed, ',') AS needed FROM (SELECT unnest(got) AS g FROM ended) JOIN events e ON e.event_id = g.event_id
"""


@query("greedy_quota", GREEDY_SQL)
def greedy_quota(spark, d):
    """Events taken in order until five overlapping buckets are full, one for each user."""
    events = bucketed_events(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"))
    taken = sampling.greedy_quota(events, "user_id", "buckets", "event_id", TARGETS)
    return taken.select("event_id", "user_id", F.array_join("needed", ",").alias("needed"))


def by_length(documents, medium: int = 100):
    """documents with bucket: medium up to so many words, long beyond; shorter than 9 words: none."""
    n = word_count(F.col("text"))
    return documents.withColumn("bucket", F.when(n < 9, None).when(n <= medium, "medium").otherwise("long"))


@query(
    "two_length_quota",
    """SELECT doc_id, bucket, nth FROM (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS nth FROM (
    SELECT doc_id, CASE WHEN n < 9 THEN NULL WHEN n <= 100 THEN 'medium' ELSE 'long' END AS bucket FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL))
    WHERE bucket IS NOT NULL) WHERE nth <= CASE bucket WHEN 'medium' THEN 40 ELSE 30 END""",
)
def two_length_quota(spark, d):
    """The first 40 medium and 30 long documents."""
    rows = by_length(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")).select("doc_id", "bucket")
    return sampling.first_of_each(rows, "bucket", "doc_id", LENGTHS).select("doc_id", "bucket", "nth")


@query(
    "scan_until",
    """SELECT event_id, user_id, nth FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS nth FROM (
    SELECT *, row_number() OVER (ORDER BY event_id) AS place FROM events) WHERE place <= 800 AND event_type = 'purchase' AND value > 2) WHERE nth <= 100""",
)
def scan_until(spark, d):
    """Purchases above 2, in order, until there are 100 or 800 events were examined."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.first_until(events, (F.col("event_type") == "purchase") & (F.col("value") > 2), "event_id", 100, 800).select("event_id", "user_id", "nth")


VIEWS = {"image": 0.35, "words": 0.40}


def two_views(embeddings):
    """The halves of each vector as two views; the table's vectors are farther apart than encoders' (hence VIEWS, not .85 and .90)."""
    return embeddings.select("vec_id", "label", F.slice("embedding", 1, 32).alias("image"), F.slice("embedding", 33, 32).alias("words"))


@query(
    "memory_bank_gate",
    """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings),
    u AS (SELECT vec_id, label, nth, list_transform(v[1:32], lambda x: x / sqrt(list_inner_product(v[1:32], v[1:32]))) AS a, list_transform(v[33:64], lambda x: x / sqrt(list_inner_product(v[33:64], v[33:64]))) AS b FROM n)
    SELECT x.label, x.vec_id, count(y.vec_id) AS n_compared, count(CASE WHEN list_inner_product(x.a, y.a) > 0.35 OR list_inner_product(x.b, y.b) > 0.40 THEN 1 END) AS n_similar
    FROM u x LEFT JOIN u y ON x.label = y.label AND y.nth BETWEEN x.nth - 64 AND x.nth - 1 GROUP BY x.label, x.vec_id""",
)
def memory_bank_gate(spark, d):
    """Of the 64 vectors of its label before each, how many were compared and are alike in either view."""
    return retrieval.similar_to_last(two_views(table(spark, d, "embeddings")), "label", "vec_id", VIEWS, 64)


@query(
    "top_tenth_weights",
    """WITH s AS (SELECT event_id, event_id // 256 AS batch, value FROM events WHERE value IS NOT NULL), t AS (SELECT batch, quantile_cont(value, 0.9) AS cut FROM s GROUP BY batch)
    SELECT event_id, batch, CASE WHEN value >= cut THEN 5.0 ELSE 1.0 END::DOUBLE AS weight FROM s JOIN t USING (batch)""",
)
def top_tenth_weights(spark, d):
    """Events in batches of 256: those from the batch's 90th percentile on weigh five times as much."""
    rows = table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.floor(F.col("event_id") / 256).alias("batch"), "value")
    return sampling.top_share_weights(rows, "batch", "value", 0.9, 5.0).select("event_id", "batch", "weight")
