"""Queries of curated sets, query understanding, diagnostics, vectors and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.functions.vectors import composed, dot, unit
from sievery.operators import curation, fusion, leakage, sampling, understanding
from sievery.operators.places import binned, numbered
from sievery.operators.retrieval import knn

from .base import RUNS_SQL, labelled, query, query_vectors, run_full, run_prefix, table, vectors
from .search import PAIRS_SQL, _pairs

# ---- curated sets


@query("benchmark_builder", """WITH rows AS (SELECT p_partkey, p_name, p_type FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 5)),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY md5('1|' || p_partkey::VARCHAR), p_partkey) AS r FROM rows) WHERE r <= greatest(1, floor(100 / (SELECT count(DISTINCT p_name) FROM rows)))),
same AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY md5('2|' || p_partkey::VARCHAR), p_partkey) AS r FROM rows) WHERE r <= 6),
pos AS (SELECT s.p_partkey AS query_id, m.p_partkey AS doc_id, 2 AS grade FROM seeds s JOIN same m ON m.p_name = s.p_name WHERE s.p_partkey <> m.p_partkey),
other AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY md5('3|' || p_partkey::VARCHAR), p_partkey) AS r FROM rows) WHERE r <= 4),
neg AS (SELECT s.p_partkey AS query_id, o.p_partkey AS doc_id, 1 AS grade FROM seeds s JOIN other o ON o.p_type = s.p_type AND o.p_name <> s.p_name)
SELECT query_id, doc_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('4|' || doc_id::VARCHAR), doc_id) AS r FROM pos) WHERE r <= 5
UNION ALL SELECT query_id, doc_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('5|' || doc_id::VARCHAR), doc_id) AS r FROM neg) WHERE r <= 4""")
def benchmark_builder(spark, d):
    return curation.benchmark(table(spark, d, "part"), "p_partkey", "p_name", "p_type", 100, 5, 4, 5, 1)


@query("candidate_union", f"WITH {RUNS_SQL}, c AS (SELECT query_id, doc_id, 0 AS o, 'full' AS source FROM run_a WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 1, 'prefix' FROM run_b WHERE rank <= 20) SELECT query_id, doc_id, arg_min(source, o) AS source FROM c GROUP BY query_id, doc_id")
def candidate_union(spark, d):
    return curation.candidate_union([("full", run_full(spark, d).where("rank <= 20")), ("prefix", run_prefix(spark, d).where("rank <= 20"))])


@query("pair_triplets", f"""WITH {RUNS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('6|' || doc_id::VARCHAR), doc_id) - 1 AS p FROM run_a WHERE grade > 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) - 1 AS p, count(*) OVER (PARTITION BY query_id) AS n FROM run_a WHERE grade <= 0)
SELECT p.query_id, p.doc_id AS positive, n.doc_id AS negative FROM p JOIN n ON n.query_id = p.query_id AND n.p = p.p % n.n WHERE p.p < 10""")
def pair_triplets(spark, d):
    return curation.triplets(run_full(spark, d), 10, 6)


@query("sibling_categories", "WITH c AS (SELECT DISTINCT p_type || '/' || p_brand AS category, p_type AS parent FROM part) SELECT a.category, b.category AS sibling FROM c a JOIN c b USING (parent) WHERE a.category <> b.category")
def sibling_categories(spark, d):
    return curation.siblings(table(spark, d, "part").withColumn("path", F.concat_ws("/", "p_type", "p_brand")), "path")


@query("scarcest_bucket", """WITH e AS (SELECT p_partkey, p_retailprice, unnest(list_filter([CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN contains(p_name, 'blue') THEN 'blue' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END], lambda x: x IS NOT NULL)) AS b FROM part),
t AS (SELECT b, count(*) AS have, CASE b WHEN 'large' THEN 100.0 WHEN 'blue' THEN 50.0 ELSE 20.0 END AS aim FROM e GROUP BY b),
m AS (SELECT p_partkey, p_retailprice, min({'r': round(have / aim, 9), 'b': e.b, 'aim': aim}) AS m FROM e JOIN t USING (b) GROUP BY ALL)
SELECT p_partkey, p_retailprice, m.b AS bucket FROM m QUALIFY row_number() OVER (PARTITION BY m.b ORDER BY p_retailprice DESC, p_partkey) <= m.aim""")
def scarcest_bucket(spark, d):
    b = tx.rules_met([("large", F.col("p_size") > 25), ("blue", F.contains("p_name", F.lit("blue"))), ("dear", F.col("p_retailprice") > 1000)])
    return curation.scarcest_bucket(table(spark, d, "part").withColumn("b", b), "b", {"large": 100, "blue": 50, "dear": 20}, "p_partkey", "p_retailprice")


@query("false_negative_filter", f"WITH {RUNS_SQL}, x AS (SELECT *, max(CASE WHEN grade > 0 THEN score END) OVER (PARTITION BY query_id) AS best FROM run_a) SELECT query_id, doc_id FROM x WHERE grade > 0 OR best IS NULL OR score <= 0.9 * best")
def false_negative_filter(spark, d):
    return curation.false_negative_filter(run_full(spark, d), 0.9).select("query_id", "doc_id")


@query("score_weights", "SELECT event_id, round(greatest(0.01, least(1.0, value / 100)), 6) AS linear, round(1000 / sqrt(1000 - least(value, 999) + 1), 6) AS inverse FROM events")
def score_weights(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(curation.linear_weight(F.col("value"), F.lit(1)), 6).alias("linear"), F.round(curation.inverse_sqrt_weight(F.least("value", F.lit(999.0)), 1000.0), 6).alias("inverse"))


@query("weighted_order", "SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id::VARCHAR), doc_id LIMIT 100")
def weighted_order(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(*sampling.shuffled(11, "doc_id")).limit(100)


@query("distinct_in_order", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_in_order(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    seen = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("s"))
    return seen.select("user_id", F.array_join(F.transform("s", lambda x: x["event_type"]), ",").alias("types"))


# ---- query understanding

VOCABULARY = {"color": ["red", "blue", "green", "white", "black"], "thing": ["ring", "bolt", "gear", "widget"]}


@query("ner_boost_terms", "SELECT p_partkey AS id, concat_ws(' ', p_name, nullif(array_to_string(list_concat(list_sort(list_intersect(['red', 'blue', 'green', 'white', 'black'], regexp_extract_all(lower(p_name), '[a-z0-9]+'))), list_sort(list_intersect(['ring', 'bolt', 'gear', 'widget'], regexp_extract_all(lower(p_name), '[a-z0-9]+')))), ' '), '')) AS expanded FROM part")
def ner_boost_terms(spark, d):
    p = table(spark, d, "part").withColumn("m", understanding.found_entities(F.col("p_name"), VOCABULARY))
    return p.select(F.col("p_partkey").alias("id"), F.rtrim(understanding.with_entities(F.col("p_name"), F.col("m"))).alias("expanded"))


@query("synonym_expand")
def synonym_expand(spark, d):
    """Longest-match expansion is sequential: no SQL form, tested by cases."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return understanding.expand_synonyms(p, "text", {"blue": ["navy", "azure"], "ring": ["band"], "blue ring": ["sapphire band"]})


@query("checked_replies", "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'unknown' ELSE 'unknown' END AS verdict, quality IS NULL AS dropped FROM documents LEFT JOIN labels USING (doc_id)")
def checked_replies(spark, d):
    replies = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("odd").alias("verdict"))
    return understanding.checked_replies(table(spark, d, "documents"), replies, "doc_id", {"verdict": ["good", "bad"]})


@query("first_turns", "SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS turns, max(len(text)) AS longest FROM conversations GROUP BY conv_id")
def first_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))


# ---- vectors


@query("biencoder_rescore", f"WITH {PAIRS_SQL}, s AS (SELECT query_id, doc_id, round(list_inner_product(qv[1:8], dv[1:8]), 6) AS score FROM pairs) SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def biencoder_rescore(spark, d):
    p = _pairs(spark, d)
    scores = p.select("query_id", "doc_id", dot(F.slice("qv", 1, 8), F.slice("dv", 1, 8)).alias("score"))
    return fusion.rescored(run_full(spark, d), scores, 10).select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


@query("moe_gated_score", f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round(list_inner_product(qv, dv) + 0.25 * CASE WHEN q.label < 5 THEN list_inner_product(qv[1:16], dv[1:16]) ELSE 0 END + 0.30 * CASE WHEN q.label % 2 = 0 THEN list_inner_product(qv[17:32], dv[17:32]) ELSE 0 END + 0.15 * list_inner_product(qv[33:48], dv[33:48]), 6) AS score FROM pairs JOIN e q ON q.vec_id = query_id")
def moe_gated(spark, d):
    """Candidates scored by the whole vector and by parts of it, two of them gated by what the query's label says."""
    part = lambda a: dot(F.slice("qv", a, 16), F.slice("dv", a, 16))
    label = vectors(spark, d).select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql"))
    s = dot(F.col("qv"), F.col("dv")) + 0.25 * F.when(F.col("ql") < 5, part(1)).otherwise(0.0) + 0.30 * F.when(F.col("ql") % 2 == 0, part(17)).otherwise(0.0) + 0.15 * part(33)
    return _pairs(spark, d).join(label, "query_id").select("query_id", "doc_id", F.round(s, 6).alias("score"))


@query("alpha_sweep", f"WITH {RUNS_SQL}, a AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS alpha), w AS (SELECT alpha, vec_id, label, list_transform(range(1, 33), lambda i: alpha * u[i] + (1 - alpha) * u[i + 32]) AS w FROM e, a), c AS (SELECT alpha, vec_id, label, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM w), r AS (SELECT q.alpha, q.vec_id AS query_id, (q.label = x.label)::INT AS grade FROM c q JOIN c x ON q.alpha = x.alpha AND q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id QUALIFY row_number() OVER (PARTITION BY q.alpha, q.vec_id ORDER BY round(list_inner_product(q.u, x.u), 6) DESC, x.vec_id) <= 10) SELECT alpha, round(avg(p), 6) AS precision_10 FROM (SELECT alpha, query_id, sum(grade) / 10.0 AS p FROM r GROUP BY ALL) GROUP BY alpha")
def alpha_sweep(spark, d):
    """Searches over mixes of the two halves of a vector at each alpha, and their precision at 10."""
    g, out = vectors(spark, d), None
    for a in (0.2, 0.5, 0.8):
        c = g.withColumn("vector", composed([(F.slice("vector", 1, 32), a), (F.slice("vector", 33, 32), 1 - a)]))
        run = labelled(knn(query_vectors(c), c, 10), g).groupBy("query_id").agg((F.sum("grade") / 10.0).alias("p")).select(F.lit(a).alias("alpha"), "p")
        out = run if out is None else out.unionByName(run)
    return out.groupBy("alpha").agg(F.round(F.avg("p"), 6).alias("precision_10"))


@query("label_centroids", f"WITH {RUNS_SQL}, c AS (SELECT label, i, avg(u[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL), v AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label) SELECT e.label, count(*) AS n, round(avg(list_inner_product(u, m) / sqrt(list_inner_product(m, m))), 6) AS mean_similarity FROM e JOIN v USING (label) GROUP BY e.label")
def label_centroids(spark, d):
    g = vectors(spark, d)
    c = g.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    v = c.groupBy("label").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("c"))
    return g.join(F.broadcast(v), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("vector"), F.col("c"))), 6).alias("mean_similarity"))


@query("linear_probe")
def linear_probe(spark, d):
    """Held-out accuracy of logistic regression on the vectors: an iterative fit, so no SQL form."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, d).select("doc_id", F.col("label").cast("double").alias("label"), array_to_vector("vector").alias("features"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows.where(~held))
    return model.transform(rows.where(held)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("pca_projection")
def pca_projection(spark, d):
    """Uncentred principal directions from the second-moment matrix; their signs are fixed by the largest entry."""
    import numpy as np

    g = vectors(spark, d)
    x = g.select("vector", F.posexplode("vector").alias("i", "x")).select("i", "x", F.posexplode("vector").alias("j", "y"))
    cells = x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()  # dims squared, summed before any shuffle
    n = 1 + max((c["i"] for c in cells), default=-1)
    m = np.zeros((n, n))
    for c in cells:
        m[c["i"], c["j"]] = c["s"]
    _, basis = np.linalg.eigh(m)
    top = basis[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    parts = [F.round(dot(F.col("vector"), F.array(*[F.lit(float(v)) for v in top[:, k]])), 6).alias(f"pc{k + 1}") for k in range(top.shape[1])]
    return g.select("doc_id", *parts)


# ---- diagnostics and sets


@query("disagreement_buckets", f"WITH {RUNS_SQL}, a AS (SELECT query_id, min(CASE WHEN grade > 0 THEN rank END) AS ra FROM run_a GROUP BY 1), b AS (SELECT query_id, min(CASE WHEN grade > 0 THEN rank END) AS rb FROM run_b GROUP BY 1) SELECT count(*) FILTER (ra = 1 AND rb = 1) AS both_top, count(*) FILTER (ra = 1 AND coalesce(rb, 999) > 1) AS a_top_only, count(*) FILTER (rb = 1 AND coalesce(ra, 999) > 1) AS b_top_only, count(*) FILTER (coalesce(ra, 999) > 10 AND coalesce(rb, 999) > 10) AS both_miss, count(*) FILTER (abs(coalesce(ra, 999) - coalesce(rb, 999)) > 5) AS far_apart FROM a JOIN b USING (query_id)")
def disagreement_buckets(spark, d):
    first = lambda run, n: run.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(999)).alias(n))
    j = first(run_full(spark, d), "ra").join(first(run_prefix(spark, d), "rb"), "query_id")
    a, b = F.col("ra"), F.col("rb")
    return j.agg(F.count_if((a == 1) & (b == 1)).alias("both_top"), F.count_if((a == 1) & (b > 1)).alias("a_top_only"), F.count_if((b == 1) & (a > 1)).alias("b_top_only"), F.count_if((a > 10) & (b > 10)).alias("both_miss"), F.count_if(F.abs(a - b) > 5).alias("far_apart"))


@query("near_miss", "WITH q AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t, p_name FROM part WHERE p_partkey % 50 = 0), n AS (SELECT DISTINCT p_name AS name, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t FROM part) SELECT q.id, CASE WHEN r >= 0.7 THEN 'near_miss' WHEN r >= 0.3 THEN 'mixed' ELSE 'totally_wrong' END AS class FROM (SELECT q.id, avg(list_has_any(q.t, n.t)::INT) AS r FROM q, n WHERE n.name <> q.p_name GROUP BY q.id) q")
def near_miss(spark, d):
    """How many of the other names share a word with the query's: per name, not per part, so the join is on words."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_name").alias("name")).distinct()
    total = names.agg((F.count("*") - 1).alias("others"))
    word = names.select("name", F.explode(F.array_distinct(tx.tokens(F.col("name")))).alias("w"))
    share = word.join(word.select(F.col("name").alias("other"), "w"), "w").where("name <> other").select("name", "other").distinct().groupBy("name").agg(F.count("*").alias("met"))
    r = names.join(share, "name", "left").join(F.broadcast(total)).select("name", (F.coalesce("met", F.lit(0)) / F.col("others")).alias("r"))
    q = p.where(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return q.join(r, "name").select("id", F.when(F.col("r") >= 0.7, "near_miss").when(F.col("r") >= 0.3, "mixed").otherwise("totally_wrong").alias("class"))


@query("word_histogram", "SELECT (floor(n / 5) * 5)::BIGINT AS bin, count(*) AS docs FROM (SELECT least(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')), 500) AS n FROM documents) GROUP BY 1")
def word_histogram(spark, d):
    n = F.least(tx.word_count(F.col("text")), F.lit(500))
    return table(spark, d, "documents").groupBy((F.floor(n / 5) * 5).cast("long").alias("bin")).agg(F.count("*").alias("docs"))


@query("manifest_shares", "SELECT source, lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source, lang")
def manifest_shares(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("majority_label", "SELECT lang, arg_max(quality, n * 10 - quality) AS majority FROM (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang")
def majority_label(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.max_by("quality", F.struct("n", (-F.col("quality")).alias("q"))).alias("majority"))


@query("top_bottom_fifth", "WITH s AS (SELECT p_name, avg(p_retailprice) AS m, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_name) AS r, count(*) OVER () AS n FROM part GROUP BY p_name) SELECT round(avg(CASE WHEN r <= n // 5 THEN m END), 6) AS top_mean, round(avg(CASE WHEN r > n - n // 5 THEN m END), 6) AS bottom_mean FROM s")
def top_bottom_fifth(spark, d):
    # means are stored: sums of doubles computed twice could differ and fall into another bin
    s = table(spark, d, "part").groupBy("p_name").agg(F.avg("p_retailprice").alias("m")).withColumn("down", -F.col("m")).persist()
    s = numbered(binned(s, "down"), [], ["down", "p_name"]).withColumnRenamed("_nth", "r").join(F.broadcast(s.agg(F.count("*").alias("n"))))
    fifth = F.expr("n div 5")
    return s.agg(F.round(F.avg(F.when(F.col("r") <= fifth, F.col("m"))), 6).alias("top_mean"), F.round(F.avg(F.when(F.col("r") > F.col("n") - fifth, F.col("m"))), 6).alias("bottom_mean"))


@query("common_queries", f"WITH {RUNS_SQL} SELECT DISTINCT query_id FROM run_a WHERE grade > 0 AND rank <= 3 INTERSECT SELECT query_id FROM run_b WHERE grade > 0 AND rank <= 3")
def common_queries(spark, d):
    good = "grade > 0 AND rank <= 3"
    return leakage.overlaps(run_full(spark, d).where(good), run_prefix(spark, d).where(good), "query_id")


@query("oracle_router", f"WITH {RUNS_SQL}, a AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN grade ELSE 0 END) AS h FROM run_a GROUP BY 1), b AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN grade ELSE 0 END) AS h FROM run_b GROUP BY 1) SELECT round(avg(greatest(a.h, b.h)), 6) AS best_of_both FROM a JOIN b USING (query_id)")
def oracle_router(spark, d):
    hit = lambda run, n: run.groupBy("query_id").agg(F.max(F.when(F.col("rank") <= 1, F.col("grade")).otherwise(0)).alias(n))
    return hit(run_full(spark, d), "a").join(hit(run_prefix(spark, d), "b"), "query_id").agg(F.round(F.avg(F.greatest("a", "b")), 6).alias("best_of_both"))


@query("depth_sweep", f"WITH {RUNS_SQL} SELECT k::INT AS depth, round(avg(r), 6) AS recall FROM (SELECT k, query_id, sum(grade) FILTER (rank <= k) / max(n_rel) AS r FROM run_a JOIN rel USING (query_id), (VALUES (10), (50), (100)) t(k) GROUP BY ALL) GROUP BY k")
def depth_sweep(spark, d):
    from .base import relevant

    run = run_full(spark, d).join(relevant(vectors(spark, d)), "query_id").withColumn("depth", F.explode(F.array(F.lit(10), F.lit(50), F.lit(100))))
    per = run.groupBy("depth", "query_id").agg((F.sum(F.when(F.col("rank") <= F.col("depth"), F.col("grade")).otherwise(0)) / F.max("n_rel")).alias("r"))
    return per.groupBy("depth").agg(F.round(F.avg("r"), 6).alias("recall"))


@query("score_gap", f"WITH {RUNS_SQL} SELECT query_id, round(max(score) - max(CASE WHEN grade > 0 THEN score END), 6) AS gap FROM run_b GROUP BY query_id")
def score_gap(spark, d):
    return run_prefix(spark, d).groupBy("query_id").agg(F.round(F.max("score") - F.max(F.when(F.col("grade") > 0, F.col("score"))), 6).alias("gap"))


@query("minmax_fusion", f"WITH {RUNS_SQL}, a AS (SELECT query_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM run_a WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM run_b WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(0.3 * a.s + 0.7 * b.s, 6) AS score FROM a JOIN b USING (query_id, doc_id)")
def minmax_fusion(spark, d):
    return fusion.mixed_scores(fusion.min_max(run_full(spark, d)), fusion.min_max(run_prefix(spark, d)), 0.3).select("query_id", "doc_id", "score")
