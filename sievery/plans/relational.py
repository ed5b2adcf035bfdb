"""Queries of texts, profiles, samples, statistics, leakage and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.operators import leakage, profiling, sampling, stats
from sievery.sources import tables

from .base import RUNS_SQL, query, run_full, run_prefix, table, vectors

U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

# ---- texts


@query("article_text", "SELECT p_partkey AS id, concat_ws(' | ', p_name, p_brand, p_type, substr(p_size::VARCHAR, 1, 200)) AS text FROM part")
def article_text(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.article_text([F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")]).alias("text"))


@query("article_text_tagged", "SELECT p_partkey AS id, p_name || ' | ' || substr(p_type, 1, 150) || ' [COLOR] ' || split_part(p_name, ' ', 1) || ' [BRAND] ' || p_brand AS text FROM part")
def article_tagged(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.tagged_text(F.col("p_name"), F.col("p_type"), [("COLOR", F.split_part("p_name", F.lit(" "), F.lit(1))), ("BRAND", F.col("p_brand"))]).alias("text"))


@query("caption_set", "SELECT p_partkey AS id, concat_ws(';', 'a ' || p_name, CASE WHEN p_size > 25 THEN 'a large ' || p_name END, CASE WHEN p_retailprice > 1000 THEN p_brand || ' ' || p_name END) AS captions FROM part")
def caption_set(spark, d):
    p = table(spark, d, "part")
    c = tx.captions([F.concat(F.lit("a "), "p_name"), F.when(F.col("p_size") > 25, F.concat(F.lit("a large "), "p_name")), F.when(F.col("p_retailprice") > 1000, F.concat_ws(" ", "p_brand", "p_name"))], F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(c, ";").alias("captions"))


@query("length_bucket", "SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN w <= 8 THEN 'short' WHEN w <= 25 THEN 'medium' ELSE 'long' END AS b FROM (SELECT len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents)) GROUP BY b")
def length_bucket(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(tx.length_bucket(tx.word_count(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("token_freq", "SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 50")
def token_freq(spark, d):
    return profiling.token_frequencies(table(spark, d, "documents"), F.col("text"), 50)


@query("bigram_freq", "SELECT value, count(*) AS n FROM (SELECT unnest(list_transform(list_zip(t[1:-2], t[2:]), lambda x: x[1] || ' ' || x[2])) AS value FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents) WHERE len(t) > 1) GROUP BY value ORDER BY n DESC, value LIMIT 50")
def bigram_freq(spark, d):
    return profiling.token_frequencies(table(spark, d, "documents"), F.col("text"), 50, pairs=True)


@query("cooccurrence_sets", """SELECT * FROM (SELECT 'p_brand' AS field_a, p_brand AS value_a, 'p_type' AS field_b, p_type AS value_b, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_brand', p_brand, 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'p_type', p_type, 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY ALL) ORDER BY n DESC, field_a, value_a, field_b, value_b LIMIT 20""")
def cooccurrence(spark, d):
    return profiling.cooccurrence(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], 20)


@query("value_concentration", "WITH c AS (SELECT p_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY p_name) SELECT round(sum(CASE WHEN r <= 5 THEN n END) / sum(n), 6) AS top5_share, round(sum(CASE WHEN r <= 10 THEN n END) / sum(n), 6) AS top10_share FROM c")
def value_concentration(spark, d):
    return profiling.concentration(table(spark, d, "part"), "p_name")


@query("scan_parts_profile", """WITH t AS (SELECT p_name AS t, len(string_split(p_name, ' ')) AS w FROM part) SELECT count(*) AS rows, 0.0::DOUBLE AS null_rate, count(DISTINCT t) AS unique_texts, round(1 - count(DISTINCT t) / count(t), 6) AS duplicate_rate, min(w)::INT AS min_words, max(w)::INT AS max_words,
round(avg(w), 6) AS mean_words, round(avg(length(t)), 6) AS mean_chars, round(avg((w <= 8)::INT), 6) AS short, round(avg((w > 8 AND w <= 25)::INT), 6) AS medium, round(avg((w > 25)::INT), 6) AS long FROM t""")
def parts_profile(spark, d):
    return profiling.text_profile(table(spark, d, "part"), F.col("p_name"))


@query("position_quantiles", "WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT s AS share, n_chars AS value FROM o, (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(s) WHERE i = floor(n * s)")
def position_quantiles(spark, d):
    return profiling.by_position(table(spark, d, "documents"), "n_chars", [0.1, 0.5, 0.9])


@query("text_style_flags", "SELECT round(avg(contains(text, ',')::INT), 6) AS comma, round(avg(contains(text, '.')::INT), 6) AS period, round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS digit, round(avg((text = lower(text))::INT), 6) AS all_lower, round(avg(regexp_matches(text, '^[A-Z]')::INT), 6) AS starts_upper FROM documents")
def text_style_flags(spark, d):
    t = F.col("text")
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return table(spark, d, "documents").agg(share(F.contains(t, F.lit(",")), "comma"), share(F.contains(t, F.lit(".")), "period"), share(t.rlike("[0-9]"), "digit"), share(t == F.lower(t), "all_lower"), share(t.rlike("^[A-Z]"), "starts_upper"))


RULES = [("warm", ["red", "orange", "pink"]), ("cold", ["blue", "green", "white"]), ("hard", ["bolt", "gear", "ring"])]


@query("classify_l1", "WITH t AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part) SELECT id, CASE WHEN list_has_any(w, ['red', 'orange', 'pink']) THEN 'warm' WHEN list_has_any(w, ['blue', 'green', 'white']) THEN 'cold' WHEN list_has_any(w, ['bolt', 'gear', 'ring']) THEN 'hard' ELSE 'other' END AS class FROM t")
def classify_l1(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.first_rule(tx.tokens(F.col("p_name")), RULES, "other").alias("class"))


@query("pattern_buckets", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN contains(p_name, 'blue') THEN 'blue' END) AS buckets FROM part")
def pattern_buckets(spark, d):
    b = tx.rules_met([("large", F.col("p_size") > 25), ("dear", F.col("p_retailprice") > 1000), ("blue", F.contains("p_name", F.lit("blue")))])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(b, ",").alias("buckets"))


@query("suspicious_case", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 40 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, ' | ') THEN 'table' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def suspicious_case(spark, d):
    r = tx.first_reason([("short", F.col("n_chars") < 40), ("long", F.col("n_chars") > 10000), ("shouting", F.contains("text", F.lit("!!"))), ("table", F.contains("text", F.lit(" | ")))])
    return table(spark, d, "documents").select(r.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("extract_fields", "SELECT p_partkey AS id, list_filter(['red', 'blue', 'green', 'white', 'black'], lambda c: list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), c))[1] AS color, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
def extract_fields(spark, d):
    w = tx.tokens(F.col("p_name"))
    color = F.get(F.filter(F.array(*map(F.lit, ["red", "blue", "green", "white", "black"])), lambda c: F.array_contains(w, c)), F.lit(0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), color.alias("color"), F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large").alias("size_class"))


@query("json_reply_parse", "SELECT event_id, (regexp_extract(props, '\"k\": *([0-9]+)', 1))::INT AS k, (event_type IN ('view', 'click', 'purchase')) AS known FROM events")
def json_reply(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object(tx.json_object(F.col("props")), "$.k").cast("int").alias("k"), F.col("event_type").isin("view", "click", "purchase").alias("known"))


@query("content_name", "SELECT doc_id, substr(sha256(concat_ws('|', source, doc_id::VARCHAR)), 1, 24) AS name FROM documents")
def content_name(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_name(F.col("source"), F.col("doc_id")).alias("name"))


@query("image_path", "SELECT p_partkey AS id, substr(lpad(p_partkey::VARCHAR, 10, '0'), 1, 3) || '/' || lpad(p_partkey::VARCHAR, 10, '0') || '.jpg' AS path FROM part")
def image_path(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tables.image_path(F.col("p_partkey")).alias("path"))


# ---- groups and samples


@query("group_size_filter", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 5")
def group_size_filter(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n >= 5")


@query("qrels_normalise", "SELECT query_id, doc_id, max(g)::INT AS grade FROM (SELECT user_id::VARCHAR AS query_id, unnest(string_split(string_agg(event_id::VARCHAR, ' '), ' ')) AS doc_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS g FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id, event_type) GROUP BY ALL")
def qrels_normalise(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "view") & F.col("event_id").isNotNull())
    grade = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    rows = e.select(F.col("user_id").cast("string").alias("query_id"), F.col("event_id").cast("string").alias("doc_id"), grade.alias("grade"))
    return rows.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


@query("split_by_text", f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {U.format('lower(trim(text))')} AS u FROM documents)")
def split_by_text(spark, d):
    return sampling.split_by_text(table(spark, d, "documents"), F.lower(F.trim("text"))).select("doc_id", "split")


@query("stratified_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 10")
def stratified_sample(spark, d):
    return sampling.per_group(table(spark, d, "documents").select("doc_id", "source"), ["source"], 10, sampling.shuffled(7, "doc_id"))


@query("proportional_sample", "WITH c AS (SELECT lang, greatest(10, floor(200 * count(*) / sum(count(*)) OVER ())) AS want FROM documents GROUP BY lang) SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) AS r FROM documents) JOIN c USING (lang) WHERE r <= want")
def proportional_sample(spark, d):
    return sampling.proportional_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", 200, 10, 7, "doc_id").select("doc_id", "lang")


@query("share_targeted_subsample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 30 WHEN 'fr' THEN 20 ELSE 0 END")
def share_sample(spark, d):
    return sampling.share_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", {"en": 0.5, "de": 0.3, "fr": 0.2}, 100, 7, "doc_id")


@query("quota_cumulative", "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 100")
def quota_cumulative(spark, d):
    return sampling.running_quota(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100)


@query("soft_quota", f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 100 OR {U.format(chr(39) + '3|' + chr(39) + ' || event_id::VARCHAR')} < 1 / sqrt(r / 100)")
def soft_quota(spark, d):
    return sampling.soft_quota(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100, 3)


@query("keep_first", "SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT md5(lower(trim(text))) AS text_md5, doc_id FROM documents) GROUP BY text_md5")
def keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", leakage.digest(F.col("text")).alias("text_md5"))
    return sampling.first_of_key(docs, F.col("text_md5"), ["doc_id"])


@query("rank_bucket_sample", f"WITH {RUNS_SQL}, b AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 'top' WHEN rank <= 40 THEN 'mid' ELSE 'tail' END AS bucket FROM run_a) SELECT query_id, doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY md5('5|' || doc_id::VARCHAR), doc_id) AS r FROM b) WHERE r <= 3")
def rank_bucket_sample(spark, d):
    b = run_full(spark, d).select("query_id", "doc_id", sampling.rank_bucket(F.col("rank")).alias("bucket"))
    return sampling.per_group(b, ["query_id", "bucket"], 3, sampling.shuffled(5, "doc_id"))


@query("hard_negatives", f"""WITH {RUNS_SQL}, x AS (SELECT *, max(CASE WHEN grade > 0 THEN score END) OVER (PARTITION BY query_id) AS best FROM run_a),
k AS (SELECT query_id, doc_id, round(ln(greatest({U.format(chr(39) + '9|' + chr(39) + " || query_id::VARCHAR || '|' || doc_id::VARCHAR")}, 1e-12)) / greatest(exp(-pow((score - 0.3) / 0.1, 2)), 1e-12), 6) AS key FROM x WHERE grade <= 0 AND (best IS NULL OR score <= 0.95 * best))
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, doc_id) AS r FROM k) WHERE r <= 5""")
def hard_negatives(spark, d):
    return sampling.hard_negatives(run_full(spark, d), 5, 0.95, 0.3, 0.1, 9).select("query_id", "doc_id")


@query("ranking_error_triplets", f"""WITH {RUNS_SQL}, bad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM run_a WHERE rank <= 20 AND grade <= 0) WHERE r <= 3), good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS r FROM run_a WHERE rank <= 20 AND grade > 0) WHERE r <= 2)
SELECT g.query_id, g.doc_id AS positive, b.doc_id AS negative FROM good g JOIN bad b USING (query_id) WHERE b.rank < g.rank""")
def ranking_errors(spark, d):
    return sampling.ranking_errors(run_full(spark, d))


@query("margin_pairs", f"WITH {RUNS_SQL}, t AS (SELECT * FROM run_a WHERE rank <= 10) SELECT a.query_id, a.doc_id AS doc_i, b.doc_id AS doc_j, round(a.score - b.score, 6) AS margin FROM t a JOIN t b USING (query_id) WHERE round(a.score - b.score, 6) > 0.05")
def margin_pairs(spark, d):
    return sampling.margin_pairs(run_full(spark, d), 0.05, 10)


@query("grouped_batches", "WITH o AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY md5('2|' || p_partkey::VARCHAR), p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_name) AS n FROM part) SELECT o.p_name, slot::INT AS slot, o.p_partkey FROM o, range(0, 50) t(slot) WHERE slot % n = p")
def grouped_batches(spark, d):
    return sampling.grouped_batches(table(spark, d, "part"), "p_name", 50, "p_partkey", 2)


@query("same_group_pairs", "WITH o AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY md5('4|' || p_partkey::VARCHAR), p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_name) AS n FROM part) SELECT a.p_partkey AS query_id, b.p_partkey AS doc_id, a.p_name FROM o a JOIN range(1, 6) t(s) ON s < a.n JOIN o b ON b.p_name = a.p_name AND b.p = (a.p + s) % a.n")
def same_group_pairs(spark, d):
    return sampling.same_group_pairs(table(spark, d, "part"), "p_partkey", "p_name", 5, 4)


@query("run_detection", "SELECT event_id, sum(new) OVER (ORDER BY event_id)::BIGINT AS run FROM (SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events)")
def run_detection(spark, d):
    return profiling.runs_of_key(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "run")


# ---- statistics


def _two(spark, d):
    """query_id, a, b: precision at 10 of the full and the prefix run."""
    p = lambda run, n: run.groupBy("query_id").agg((F.sum(F.when(F.col("rank") <= 10, F.col("grade")).otherwise(0)) / 10.0).alias(n))
    return p(run_full(spark, d), "a").join(p(run_prefix(spark, d), "b"), "query_id")


TWO_SQL = RUNS_SQL + ", two AS (SELECT query_id, a, b, row_number() OVER (ORDER BY query_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0::DOUBLE AS a FROM run_a GROUP BY 1) JOIN (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0::DOUBLE AS b FROM run_b GROUP BY 1) USING (query_id))"


def _means_sql(value):
    u = U.format("'42|' || r::VARCHAR || '|' || s.pos::VARCHAR")
    return f"means AS (SELECT r, avg({value}) AS mean FROM (SELECT r, floor({u} * s.n) AS at FROM two s, range(0, 500) t(r)) x JOIN two v ON v.pos = x.at GROUP BY r)"


def _boot(spark, d, value):
    two = stats.positioned(_two(spark, d).withColumn("one", F.lit(1)).withColumn("d", F.col("a") - F.col("b")), ["one"], "query_id")
    return stats.resampled_means(two, ["one"], value, 500)


@query("bootstrap_ci", f"WITH {TWO_SQL}, {_means_sql('v.a')} SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM means")
def bootstrap_ci(spark, d):
    return stats.interval(_boot(spark, d, "a"), ["one"]).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("paired_bootstrap", f"WITH {TWO_SQL}, {_means_sql('v.a - v.b')}, m AS (SELECT round(mean, 9) AS mean FROM means) SELECT round(least(1.0, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT))), 6) AS p_two_sided, round(avg((mean <= 0)::INT), 6) AS p_one_sided, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM m")
def paired_bootstrap(spark, d):
    t = stats.paired_test(_boot(spark, d, "d").withColumn("mean", F.round("mean", 9)), ["one"])
    return t.select(*[F.round(c, 6).alias(c) for c in ("p_two_sided", "p_one_sided", "lo", "hi")])


@query("contingency_hits", f"WITH {TWO_SQL} SELECT count(*) FILTER (a > 0 AND b > 0) AS \"both\", count(*) FILTER (a > 0 AND NOT b > 0) AS a_only, count(*) FILTER (NOT a > 0 AND b > 0) AS b_only, count(*) FILTER (NOT a > 0 AND NOT b > 0) AS neither, round(avg((a > 0 OR b > 0)::INT), 6) AS any_rate FROM two")
def contingency_hits(spark, d):
    return stats.contingency(_two(spark, d), "a", "b").withColumn("any_rate", F.round("any_rate", 6))


@query("win_loss", f"WITH {TWO_SQL} SELECT CASE WHEN a > b THEN 'win' WHEN a < b THEN 'loss' ELSE 'inconclusive' END AS outcome, count(*) AS n FROM two GROUP BY 1")
def win_loss(spark, d):
    gap = F.round(F.col("a") - F.col("b"), 9)
    return _two(spark, d).groupBy(stats.win_loss(gap, gap).alias("outcome")).agg(F.count("*").alias("n"))


@query("normal_interval", f"WITH {TWO_SQL}, m AS (SELECT avg(a) AS m, count(*) AS n FROM two) SELECT round(m - 1.96 * sqrt(m * (1 - m) / n), 6) AS lo, round(m + 1.96 * sqrt(m * (1 - m) / n), 6) AS hi FROM m")
def normal_interval(spark, d):
    lo, hi = stats.normal_interval(F.col("m"), F.col("n"))
    return _two(spark, d).agg(F.avg("a").alias("m"), F.count("*").alias("n")).select(F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("stratum_stats", "SELECT n_name AS stratum, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def stratum_stats(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("stratum"))
    return table(spark, d, "customer").join(n, "c_nationkey").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 6).alias("std"))


@query("word_failure_rate", "SELECT word, count(*) AS n, round(avg(f), 6) AS rate FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word, 1.0 - quality AS f FROM documents JOIN labels USING (doc_id)) GROUP BY word HAVING count(*) >= 20")
def word_failure(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("w", tx.tokens(F.col("text"))).withColumn("f", 1 - F.col("quality"))
    return stats.word_failure_rate(rows, "w", "f").withColumn("rate", F.round("rate", 6))


@query("drift_quantiles", f"WITH {RUNS_SQL}, x AS (SELECT 1 - list_inner_product(e.u[1:16], short.u) / sqrt(list_inner_product(e.u[1:16], e.u[1:16])) + (1 - sqrt(list_inner_product(e.u[1:16], e.u[1:16]))) AS d FROM e JOIN short USING (vec_id)) SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS max FROM x")
def drift_quantiles(spark, d):
    """How far 16-dimensional prefixes lie from the whole vectors: 1 - the prefix's length."""
    from sievery.functions.vectors import norm

    x = vectors(spark, d).select((1 - norm(F.slice("vector", 1, 16))).alias("d"))
    q = lambda p, n: F.round(F.expr(f"percentile(d, {p})"), 6).alias(n)
    return x.agg(F.round(F.avg("d"), 6).alias("mean"), q(0.5, "median"), q(0.9, "p90"), q(0.99, "p99"), F.round(F.max("d"), 6).alias("max"))


@query("label_agreement", "SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT), 6) AS exact, round(avg((abs(quality - (1 - toxic)) <= 1)::INT), 6) AS within_one, round(avg(abs(quality - (1 - toxic))), 6) AS mean_difference FROM labels")
def label_agreement(spark, d):
    return profiling.agreement(table(spark, d, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")


@query("label_distribution", "SELECT source, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY source, quality")
def label_distribution(spark, d):
    c = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("fine_coarse_recall", f"WITH {RUNS_SQL} SELECT round(100 * avg(h1), 2) AS r1, round(100 * avg(h5), 2) AS r5, round(100 * avg(h10), 2) AS r10, round(100 * avg(h20), 2) AS r20 FROM (SELECT query_id, max(CASE WHEN rank <= 1 THEN grade ELSE 0 END) AS h1, max(CASE WHEN rank <= 5 THEN grade ELSE 0 END) AS h5, max(CASE WHEN rank <= 10 THEN grade ELSE 0 END) AS h10, max(CASE WHEN rank <= 20 THEN grade ELSE 0 END) AS h20 FROM run_a GROUP BY 1)")
def fine_coarse(spark, d):
    run = run_full(spark, d)
    per = run.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("grade")).otherwise(0)).alias(f"h{k}") for k in (1, 5, 10, 20)])
    return per.agg(*[F.round(100 * F.avg(f"h{k}"), 2).alias(f"r{k}") for k in (1, 5, 10, 20)])


# ---- leakage, registries


@query("hash_overlap", "WITH k AS (SELECT DISTINCT md5(lower(trim(text))) AS h, source FROM documents) SELECT a.source AS a, b.source AS b, count(*) AS shared FROM k a JOIN k b ON a.h = b.h AND a.source < b.source GROUP BY ALL")
def hash_overlap(spark, d):
    return leakage.group_overlap(table(spark, d, "documents").select("source", leakage.digest(F.col("text")).alias("h")), "source", "h")


@query("text_leakage", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(d.text, '[ \\t\\n\\r]+'), lambda x: x <> ''), ' ') || ' ', ' ' || array_to_string(list_filter(regexp_split_to_array(trim(b.text), '[ \\t\\n\\r]+'), lambda x: x <> ''), ' ') || ' ')")
def text_leakage(spark, d):
    return leakage.containments(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")))


@query("split_disjoint", f"SELECT count(*) AS shared FROM (SELECT text FROM (SELECT text, {U.format('lower(trim(text))')} AS u FROM documents) GROUP BY text HAVING count(DISTINCT u < 0.8) > 1)")
def split_disjoint(spark, d):
    s = sampling.split_by_text(table(spark, d, "documents"), F.lower(F.trim("text")))
    return leakage.overlaps(s.where("split = 'train'"), s.where("split <> 'train'"), "text").agg(F.count("*").alias("shared"))


@query(
    "hamming_near_dup",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), x AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM w),
    b AS (SELECT doc_id, i, sum((h >> i) & 1) AS ones, count(*) AS n FROM x, range(60) r(i) GROUP BY doc_id, i),
    s AS (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN (1::BIGINT << i) ELSE 0 END)::BIGINT AS hash FROM b GROUP BY doc_id),
    p AS (SELECT a.doc_id AS id, bit_count(xor(a.hash, q.hash))::INT AS distance, q.doc_id AS match FROM s a JOIN s q ON a.doc_id <> q.doc_id WHERE q.doc_id % 50 = 0 AND bit_count(xor(a.hash, q.hash)) <= 6)
    SELECT id, min(distance) AS distance FROM p GROUP BY id""",
)
def hamming_near_dup(spark, d):
    """The documents near another one whose id is divisible by 50: its words' hash differs in at most 6 of 60 bits."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), leakage.simhash(tx.tokens(F.col("text"))).alias("hash")).persist()
    return leakage.hamming_nearest(rows.where("hash IS NOT NULL"), F.col("id") % 50 == 0, 6).select("id", "distance")


@query("leaderboard_upsert", "SELECT p_brand AS method, p_type AS tier, arg_max(p_retailprice, p_partkey) AS metric FROM part GROUP BY ALL")
def leaderboard_upsert(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_type").alias("tier"), F.col("p_retailprice").alias("metric"), F.col("p_partkey").alias("at"))
    old, new = rows.where("at <= 1000"), rows.where("at > 1000")
    return tables.upserted(old, new, ["tier", "method"], "at").select("method", "tier", "metric")


@query("leaderboard_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS other FROM documents GROUP BY source")
def leaderboard_pivot(spark, d):
    """Documents of each source by language; languages without a column of their own, and none, count as other."""
    known = F.when(F.col("lang").isin("en", "de", "fr", "es"), F.col("lang")).otherwise("other")
    rows = table(spark, d, "documents").select("source", known.alias("lang"))
    return rows.groupBy("source").pivot("lang", ["en", "de", "fr", "es", "other"]).agg(F.count(F.lit(1))).fillna(0, ["en", "de", "fr", "es", "other"])


@query("dense_label", "SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label_id FROM documents")
def dense_label(spark, d):
    return tables.with_dense_label(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "label_id")


@query("purchase_qrels", "SELECT o_custkey AS query_id, l_partkey AS doc_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END)::INT AS grade FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def purchase_qrels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("g"))
    return li.join(o, "o_orderkey").groupBy("query_id", "doc_id").agg(F.max("g").alias("grade"))


@query("margin_mse", f"WITH {RUNS_SQL}, p AS (SELECT a.query_id, avg(CASE WHEN a.grade > 0 THEN a.score END) - avg(CASE WHEN a.grade = 0 THEN a.score END) AS ma, avg(CASE WHEN a.grade > 0 THEN b.score END) - avg(CASE WHEN a.grade = 0 THEN b.score END) AS mb FROM run_a a JOIN run_b b USING (query_id, doc_id) GROUP BY 1) SELECT round(avg((ma - mb) * (ma - mb)), 6) AS loss FROM p")
def margin_mse(spark, d):
    a, b = run_full(spark, d), run_prefix(spark, d).select("query_id", "doc_id", F.col("score").alias("sb"))
    gap = lambda c: F.avg(F.when(F.col("grade") > 0, F.col(c))) - F.avg(F.when(F.col("grade") == 0, F.col(c)))
    m = a.join(b, ["query_id", "doc_id"]).groupBy("query_id").agg(gap("score").alias("ma"), gap("sb").alias("mb"))
    return m.agg(F.round(F.avg(F.pow(F.col("ma") - F.col("mb"), 2)), 6).alias("loss"))


@query("infonce_loss", f"WITH {RUNS_SQL}, x AS (SELECT query_id, max(CASE WHEN grade > 0 THEN score END) AS best, sum(exp(score / 0.1)) AS z FROM run_a GROUP BY 1) SELECT round(avg(ln(z) - best / 0.1), 6) AS loss FROM x")
def infonce_loss(spark, d):
    x = run_full(spark, d).groupBy("query_id").agg(F.max(F.when(F.col("grade") > 0, F.col("score"))).alias("best"), F.sum(F.exp(F.col("score") / 0.1)).alias("z"))
    return x.agg(F.round(F.avg(F.ln("z") - F.col("best") / 0.1), 6).alias("loss"))
