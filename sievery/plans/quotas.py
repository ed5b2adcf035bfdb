"""Samples with exact totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievery.operators import quotas

from .base import query, table


def filled_sql(groups: str, by: str, total: str) -> str:
    """Quotas of a table with (by, n, w) as quotas.filled() shares them."""
    return f"""
_l AS (SELECT *, row_number() OVER (ORDER BY n / w, {by} NULLS LAST) AS seat, (least({total}, sum(n) OVER ()) - coalesce(sum(n) OVER (ORDER BY n / w, {by} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY n / w, {by} NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM {groups}),
_s AS (SELECT *, least(n::DOUBLE, coalesce((SELECT arg_min(lv, seat) FROM _l WHERE lv * w <= n) * w, n::DOUBLE)) AS share FROM _l),
_b AS (SELECT *, floor(share + 1e-9)::BIGINT AS base FROM _s),
_q AS (SELECT *, base + (row_number() OVER (ORDER BY round(share - base, 9) DESC, {by} NULLS LAST) <= least({total}, sum(n) OVER ()) - sum(base) OVER ())::BIGINT AS quota FROM _b)"""


def picked_sql(rows: str, by: str, seed: int, key: str) -> str:
    return f"""SELECT r.{key}, r.{by} FROM (SELECT {key}, {by}, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || {key}), {key}) AS nth FROM {rows}) r
    JOIN _q ON r.{by} IS NOT DISTINCT FROM _q.{by} WHERE nth <= quota"""


@query("equal_sample", f"WITH g AS (SELECT source, count(*) AS n, 1.0::DOUBLE AS w FROM documents GROUP BY source), {filled_sql('g', 'source', '90')} {picked_sql('documents', 'source', 11, 'doc_id')}")
def equal_sample(spark, d):
    """90 documents in equal parts of all sources; small sources give what they have."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return quotas.shared_sample(docs, "source", 90, 11, "doc_id").select("doc_id", "source")


SHARES = {"en": 0.2, "de": 0.5, "fr": 0.3}


@query(
    "refilled_share_sample",
    f"WITH g AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 0.2 WHEN 'de' THEN 0.5 WHEN 'fr' THEN 0.3 END::DOUBLE AS w FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang), {filled_sql('g', 'lang', '150')} {picked_sql('documents', 'lang', 12, 'doc_id')}",
)
def refilled_share_sample(spark, d):
    """150 documents by language shares; what a language lacks comes from the others."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    weight = F.coalesce(*[F.when(F.col("lang") == k, w) for k, w in SHARES.items()])
    return quotas.shared_sample(docs, "lang", 150, 12, "doc_id", weight).select("doc_id", "lang")


@query(
    "proportional_quotas",
    f"""WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), f AS (SELECT p_brand, n AS size, least(n, 3) AS first FROM s),
    g AS (SELECT p_brand, size, first, size - first AS n, greatest(size - first, 1)::DOUBLE AS w FROM f), {filled_sql('g', 'p_brand', '(SELECT 120 - sum(first) FROM f)')}
    SELECT p_brand, size AS n, first + quota AS quota FROM _q""",
)
def proportional_quotas(spark, d):
    """How many parts of each brand make a sample of 120: 3 at least, the rest in proportion."""
    return quotas.proportional_quotas(table(spark, d, "part").select("p_brand"), "p_brand", 120, 3)


@query(
    "oversampled_quotas",
    """WITH s AS (SELECT event_type, 1 / sqrt(count(*)) AS w FROM events WHERE value > 0 GROUP BY event_type), q AS (SELECT *, greatest(60, floor(300 * w / sum(w) OVER ()))::BIGINT AS q FROM s)
    SELECT event_type, greatest(60, floor(q * (300.0::DOUBLE / greatest(sum(q) OVER (), 1))))::BIGINT AS quota FROM q""",
)
def oversampled_quotas(spark, d):
    """Quotas of event types that weigh rare ones more, 60 at least."""
    w = table(spark, d, "events").where("value > 0").groupBy("event_type").agg((1 / F.sqrt(F.count("*"))).alias("w"))
    return quotas.oversampled_quotas(w, 300, 60).select("event_type", "quota")


@query(
    "truth_preserving_sample",
    f"""WITH t AS (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_orderkey % 400 = 0), c AS (SELECT p_partkey, p_brand, t.p_partkey IS NOT NULL AS relevant FROM part LEFT JOIN t USING (p_partkey)),
    o AS (SELECT p_partkey, p_brand FROM c WHERE NOT relevant), g AS (SELECT p_brand, count(*) AS n, count(*)::DOUBLE AS w FROM o GROUP BY p_brand),
    {filled_sql('g', 'p_brand', '(SELECT greatest(150 - count(*), 0) FROM c WHERE relevant)')}
    SELECT p_partkey, p_brand, 'truth' AS kept_for FROM c WHERE relevant UNION ALL SELECT p_partkey, p_brand, 'fill' FROM ({picked_sql('o', 'p_brand', 13, 'p_partkey')})""",
)
def truth_preserving_sample(spark, d):
    """150 parts, or all that some orders name: these first, the rest by brand."""
    named = table(spark, d, "lineitem").where("l_orderkey % 400 = 0").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return quotas.truth_preserving(parts, named, "p_brand", 150, 13, "p_partkey")
