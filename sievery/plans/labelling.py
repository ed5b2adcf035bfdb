"""Keywords, entities, synthetic texts, fingerprints of chunks and point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.operators import chunks, spans

from .base import query, table

#: Words of the given tables' part names.
COLOURS, SIZES, THINGS = ["red", "blue", "green"], ["small", "large"], ["ring", "widget", "bolt", "gear"]


@query(
    "token_forms",
    r"""SELECT p_partkey, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+(?:''[a-z]+)?'), ' ') AS clitics, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), ' ') AS hyphens,
    array_to_string(list_transform(regexp_extract_all(t, '[a-zA-Z]+'), lambda w: lower(w)), ' ') AS letters FROM (SELECT p_partkey, p_name || '''s ' || p_brand || '-' || p_size || ' it''s' AS t FROM part)""",
)
def token_forms(spark, d):
    """Three tokenisers over a text with hyphens, apostrophes and numbers."""
    text = F.concat("p_name", F.lit("'s "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(" it's"))
    rows = table(spark, d, "part").select("p_partkey", text.alias("t"))
    forms = {"clitics": tx.tokens_with_clitics, "hyphens": tx.tokens_with_hyphens, "letters": tx.letter_tokens}
    return rows.select("p_partkey", *[F.array_join(f(F.col("t")), " ").alias(n) for n, f in forms.items()])


@query(
    "keyword_fields",
    """WITH t AS (SELECT p_partkey, lower(p_name) AS x, regexp_extract_all(lower(p_name), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM part),
    k AS (SELECT *, list_filter(w, lambda v: v IN ('small', 'red', 'ring', 'bolt', 'widget')) AS hit FROM t)
    SELECT p_partkey, array_to_string(list_sort(list_concat(list_distinct(list_filter(w, lambda v: v IN ('red', 'blue', 'green'))), list_filter(['small ring', 'red widget'], lambda v: contains(x, v)))), ',') AS found,
    CASE hit[1] WHEN 'ring' THEN 'round' WHEN 'bolt' THEN 'round' WHEN 'red' THEN 'plain' WHEN 'widget' THEN 'plain' WHEN 'small' THEN 'plain' ELSE 'other' END AS category, coalesce(hit[1], 'general') AS keyword FROM k""",
)
def keyword_fields(spark, d):
    """Colours and phrases found in names, and the category of the first known word."""
    name = F.col("p_name")
    kind = tx.first_class(name, [("round", ["ring", "bolt"]), ("plain", ["red", "widget", "small"])])
    rows = table(spark, d, "part").select("p_partkey", F.array_join(tx.keywords(name, [*COLOURS, "small ring", "red widget"]), ",").alias("found"), kind.alias("k"))
    return rows.select("p_partkey", "found", "k.category", "k.keyword")


VOCABULARY = {"phrase": ["red widget", "small ring"], "colour": COLOURS, "size": [*SIZES, "economy"], "thing": THINGS}


def named(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat_ws(" of ", "p_name", "p_type", "p_brand").alias("text"))
    return spans.with_spans(names, VOCABULARY)


@query(
    "entity_types",
    """WITH w AS (SELECT p_partkey, p_name, lower(p_type) AS t, string_split(p_name, ' ') AS x FROM part), s AS (
      SELECT p_partkey, 'phrase' AS type, len(p_name) AS l FROM w WHERE p_name IN ('red widget', 'small ring')
      UNION ALL SELECT p_partkey, CASE WHEN v IN ('red', 'blue', 'green') THEN 'colour' WHEN v IN ('small', 'large') THEN 'size' ELSE 'thing' END, len(v) FROM (SELECT p_partkey, unnest(x) AS v FROM w WHERE p_name NOT IN ('red widget', 'small ring'))
        WHERE v IN ('red', 'blue', 'green', 'small', 'large', 'ring', 'widget', 'bolt', 'gear')
      UNION ALL SELECT p_partkey, 'size', len(t) FROM w WHERE t IN ('economy', 'small', 'large')),
    k AS (SELECT p_partkey, type, count(*) AS n, sum(l) AS l, count(*) OVER (PARTITION BY p_partkey) > 1 AS multi FROM s GROUP BY p_partkey, type)
    SELECT type, sum(n)::BIGINT AS n, count(*) AS n_rows, round(sum(l) / sum(n), 6) AS mean_length, round(avg(multi::INT), 6) AS multi_share FROM k GROUP BY type""",
)
def entity_types(spark, d):
    """How often each type of entity occurs in part names, its mean length, and how often it has company."""
    stats = spans.type_stats(named(spark, d))
    return stats.select("type", "n", "n_rows", F.round("mean_length", 6).alias("mean_length"), F.round("multi_share", 6).alias("multi_share"))


@query("entity_spans")
def entity_spans(spark, d):
    """Spans of colours, sizes, things and phrases in part names, with tags; tests compare them with a loop."""
    found = spans.with_tags(named(spark, d))
    return found.select("p_partkey", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["type"], s["term"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"), F.array_join("tags", " ").alias("tags"))


POOLS = {
    "shape": ["dress", "shirt", "jacket", "coat", "skirt", "vest"],
    "sleeve": ["short", "long", "puff", "bell"],
    "cloth": ["cotton", "silk", "wool", "denim", "linen"],
    "print": ["plain", "floral", "striped", "checked"],
}
TEMPLATE = "A {shape} with {sleeve} sleeves in {cloth} or {cloth}, {print}"
PREFIXES, SUFFIXES, TONES = ["stylish ", "classic ", "simple "], [" for every day", " as a gift", " to travel with"], ["muted tones", "bold look"]


def drawn_sql(pool: list[str], slot: str) -> str:
    words = ", ".join(f"'{w}'" for w in pool)
    return f"([{words}])[(('0x' || substr(md5('7|{slot}|' || p_partkey), 1, 8))::BIGINT % {len(pool)} + 1)::INT]"


@query(
    "synthetic_texts",
    f"""SELECT p_partkey, 0 AS variant, 'template' AS kind, 'A ' || {drawn_sql(POOLS['shape'], 'shape1')} || ' with ' || {drawn_sql(POOLS['sleeve'], 'sleeve1')} || ' sleeves in ' || {drawn_sql(POOLS['cloth'], 'cloth1')} || ' or ' || {drawn_sql(POOLS['cloth'], 'cloth2')} || ', ' || {drawn_sql(POOLS['print'], 'print1')} AS text FROM part
    UNION ALL SELECT p_partkey, 1, 'paraphrase', p_name || {drawn_sql(SUFFIXES, 'suffix')} FROM part
    UNION ALL SELECT p_partkey, 2, 'paraphrase', {drawn_sql(PREFIXES, 'prefix')} || lower(p_name) FROM part
    UNION ALL SELECT p_partkey, 3, 'paraphrase', p_name || ' - ' || {drawn_sql(TONES, 'tone')} FROM part""",
)
def synthetic_texts(spark, d):
    """For each part a filled template and three paraphrases of its name; all draws are MD5 numbers of seed, slot and key."""
    key, name = F.col("p_partkey"), F.col("p_name")
    texts = [("template", tx.filled_template(TEMPLATE, POOLS, "7", key)), ("paraphrase", F.concat(name, tx.drawn(SUFFIXES, "7", "suffix", key))), ("paraphrase", F.concat(tx.drawn(PREFIXES, "7", "prefix", key), F.lower(name))), ("paraphrase", F.concat(name, F.lit(" - "), tx.drawn(TONES, "7", "tone", key)))]
    variants = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(k).alias("kind"), t.alias("text")) for i, (k, t) in enumerate(texts)])
    return table(spark, d, "part").select("p_partkey", F.explode(variants).alias("v")).select("p_partkey", "v.*")


@query(
    "chunk_fingerprints",
    """SELECT (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % 16)::INT AS chunk, count(*) AS n,
    sum(('0x' || substr(md5(coalesce('=' || doc_id, '-') || '|' || coalesce('=' || text, '-') || '|' || coalesce('=' || source, '-')), 1, 12))::BIGINT)::VARCHAR AS print FROM documents GROUP BY 1""",
)
def chunk_fingerprints(spark, d):
    """What decides which of 16 chunks of documents a resumed job computes anew."""
    return chunks.fingerprints(table(spark, d, "documents"), "doc_id", ["text", "source"], 16)


@query(
    "point_lookup",
    """WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS p_partkey FROM lineitem WHERE l_orderkey % 500 = 0)
    SELECT l_orderkey, l_linenumber, p_partkey, coalesce(p_name, '') AS p_name FROM w LEFT JOIN part USING (p_partkey)""",
)
def point_lookup(spark, d):
    """Names of the parts in some orders, unknown parts with an empty name."""
    part = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey"))
    wanted = table(spark, d, "lineitem").where("l_orderkey % 500 = 0").select("l_orderkey", "l_linenumber", part.alias("p_partkey"))
    return chunks.looked_up(wanted, table(spark, d, "part"), "p_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_partkey", "p_name")
