"""Queries of retrieval, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievery.functions.text import tokens
from sievery.functions.vectors import composed, dot, joined, packed_signs, unit
from sievery.operators import fusion, metrics, retrieval

from .base import RUNS_SQL, labelled, query, query_vectors, relevant, run_full, run_prefix, table, vectors

RUN = "SELECT query_id, doc_id, score, rank::INT AS rank"


def _rank_sql(score: str, source: str, k: int = 10) -> str:
    return f"SELECT query_id, doc_id, round({score}, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, doc_id))::INT AS rank FROM {source} QUALIFY rank <= {k}"


def listed(run):
    return run.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


@query("knn_exact", f"WITH {RUNS_SQL} {RUN} FROM run_a WHERE rank <= 10")
def knn_exact(spark, d):
    g = vectors(spark, d)
    return listed(retrieval.knn(query_vectors(g), g, 10))


@query("knn_prefix_slice", f"WITH {RUNS_SQL} {RUN} FROM run_b WHERE rank <= 10")
def knn_prefix_slice(spark, d):
    return listed(run_prefix(spark, d, 10))


@query("centered_knn", f"""WITH {RUNS_SQL},
c AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(u[i]) AS m FROM e, range(1, 65) t(i) GROUP BY i)),
z0 AS (SELECT vec_id, list_transform(range(1, 65), lambda i: u[i] - m[i]) AS w FROM e, c),
z AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM z0)
SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(q.u, d.u), 6) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.u, d.u), 6) DESC, d.vec_id))::INT AS rank
FROM z q, z d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id QUALIFY rank <= 10""")
def centered_knn(spark, d):
    g = vectors(spark, d)
    means = g.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    center = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    moved = g.join(F.broadcast(center)).withColumn("vector", unit(F.zip_with("vector", "c", lambda x, y: x - y))).drop("c")
    return listed(retrieval.knn(query_vectors(moved), moved, 10))


def _pairs(spark, d):
    """The full run's top 100 with both vectors: candidates to score again."""
    g = vectors(spark, d)
    run = run_full(spark, d)
    q = g.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qv"))
    return run.join(g.select("doc_id", F.col("vector").alias("dv")), "doc_id").join(q, "query_id")


PAIRS_SQL = RUNS_SQL + ", pairs AS (SELECT r.query_id, r.doc_id, q.u AS qv, x.u AS dv FROM run_a r JOIN e q ON q.vec_id = r.query_id JOIN e x ON x.vec_id = r.doc_id)"


def _rescored(name, sql_score, score, top=10):
    """Registers a query that ranks the candidates again by an expression on qv and dv."""

    @query(name, f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round({sql_score}, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round({sql_score}, 6) DESC, doc_id))::INT AS rank FROM pairs QUALIFY rank <= {top}")
    def rescore(spark, d):
        return listed(retrieval.ranked(_pairs(spark, d).select("query_id", "doc_id", score(F.col("qv"), F.col("dv")).alias("score")), top))


_DOT = "list_inner_product"
_rescored("maxsim_rerank", "list_sum(list_transform(range(0, 4), lambda a: list_max(list_transform(range(0, 4), lambda b: list_inner_product(qv[a * 16 + 1:a * 16 + 16], dv[b * 16 + 1:b * 16 + 16])))))",
          lambda q, v: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, a: s + F.array_max(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: dot(F.slice(q, a * 16 + 1, F.lit(16)), F.slice(v, b * 16 + 1, F.lit(16)))))))


# ---- searches of the whole gallery in other forms; each SQL scores every gallery row

SIGNS_SQL = RUNS_SQL + ", sg AS (SELECT vec_id, u, list_transform(u, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END) AS b FROM e), bin AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.u AS qv, d.u AS dv, list_inner_product(q.b, d.b) AS score FROM sg q, sg d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)"


def _binary(spark, d, k):
    """The k nearest by sign bits, a long for 64 dimensions: the dot product of signs, 64 less twice the bits that differ."""
    b = vectors(spark, d).withColumn("vector", packed_signs(F.col("vector")))
    return retrieval.knn_signs(query_vectors(b), b, 64, k)


@query("knn_binary", f"WITH {SIGNS_SQL} {_rank_sql('score', 'bin')}")
def knn_binary(spark, d):
    return listed(_binary(spark, d, 10))


@query("binary_then_rerank", f"WITH {SIGNS_SQL}, top AS (SELECT * FROM bin QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 100) {_rank_sql('list_inner_product(qv, dv)', 'top')}")
def binary_then_rerank(spark, d):
    """Two stages: the 100 nearest by sign bits, then the exact product of these alone."""
    g = vectors(spark, d)
    q = g.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qv"))
    near = _binary(spark, d, 100).select("query_id", "doc_id").join(g.select("doc_id", F.col("vector").alias("dv")), "doc_id").join(q, "query_id")
    return listed(retrieval.ranked(near.select("query_id", "doc_id", dot(F.col("qv"), F.col("dv")).alias("score")), 10))


VIEW_SQL = "0.9 * list_inner_product(q.u, d.u) + 0.1 * greatest(list_inner_product(q.u, d.u), list_inner_product(q.u[1:32], d.u[1:32]), list_inner_product(q.u[33:64], d.u[33:64]))"


@query("late_max_view", f"WITH {RUNS_SQL}, j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {VIEW_SQL} AS s FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) {_rank_sql('s', 'j')}")
def late_max_view(spark, d):
    """0.9 of the parent's score and 0.1 of the best of three views. With one view fixed the score is a dot product, and
    what is among the 10 best by the best view is so by that view: three exact searches find all of them."""
    g = vectors(spark, d)
    runs = None
    for lo, hi in ((1, 64), (1, 32), (33, 64)):
        weights = F.array(*[F.lit(1.0 if lo <= i <= hi else 0.9) for i in range(1, 65)])
        q = query_vectors(g).withColumn("vector", F.zip_with("vector", weights, lambda x, w: x * w))
        run = retrieval.knn(q, g, 10, places=12).select("query_id", "doc_id", "score")
        runs = run if runs is None else runs.unionByName(run)
    return listed(retrieval.ranked(runs.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), 10))


@query("compose_views", f"""WITH {RUNS_SQL}, w AS (SELECT vec_id, list_transform(range(1, 33), lambda i: 0.9 * u[i] + 0.1 * u[i + 32]) AS w FROM e), c AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM w),
j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.u, d.u) AS s FROM c q, c d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) {_rank_sql('s', 'j')}""")
def compose_views(spark, d):
    """Search over unit vectors of 0.9 of one view and 0.1 of the other."""
    c = vectors(spark, d).withColumn("vector", composed([(F.slice("vector", 1, 32), 0.9), (F.slice("vector", 33, 32), 0.1)]))
    return listed(retrieval.knn(query_vectors(c), c, 10))


@query("concat_ensemble", f"WITH {RUNS_SQL}, w AS (SELECT vec_id, list_concat(u, u[1:16]) AS w FROM e) SELECT vec_id AS doc_id, len(w)::INT AS dims, round(w[1] / sqrt(list_inner_product(w, w)), 6) AS first FROM w")
def concat_ensemble(spark, d):
    c = vectors(spark, d).withColumn("w", joined(F.col("vector"), F.slice("vector", 1, 16)))
    return c.select("doc_id", F.size("w").alias("dims"), F.round(F.col("w")[0], 6).alias("first"))


@query("int8_calibration", f"""WITH {RUNS_SQL},
r AS (SELECT i, min(u[i]) AS lo, max(u[i]) AS hi FROM e, range(1, 65) t(i) GROUP BY i)
SELECT i::INT AS dim, round(lo, 6) AS lo, round(hi, 6) AS hi, round(avg(abs((round_even((u[i] - lo) / (hi - lo) * 255, 0) / 255 * (hi - lo) + lo) - u[i])), 6) AS mean_error FROM e, r GROUP BY i, lo, hi""")
def int8_calibration(spark, d):
    """Per-dimension calibration and its error: values go to 0..255 between the dimension's least and greatest, and back."""
    x = vectors(spark, d).select(F.posexplode("vector").alias("i", "x"))
    r = x.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    back = F.rint((F.col("x") - F.col("lo")) / span * 255) / 255 * span + F.col("lo")
    return x.join(F.broadcast(r), "i").groupBy("i", "lo", "hi").agg(F.round(F.avg(F.abs(back - F.col("x"))), 6).alias("mean_error")).select((F.col("i") + 1).alias("dim"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "mean_error")


@query("knn_int8", f"""WITH {RUNS_SQL}, r AS (SELECT i, min(u[i]) AS lo, max(u[i]) AS hi FROM e, range(1, 65) t(i) GROUP BY i),
z AS (SELECT vec_id, list(round_even((u[i] - lo) / (hi - lo) * 255, 0) / 255 * (hi - lo) + lo ORDER BY i) AS u FROM e, r GROUP BY vec_id),
j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.u, d.u) AS s FROM e q, z d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) {_rank_sql('s', 'j')}""")
def knn_int8(spark, d):
    """Float queries against the gallery's vectors after 8 bits a dimension, calibrated on the gallery; one row of bounds is broadcast."""
    g = vectors(spark, d)
    r = g.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = r.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    back = F.zip_with("vector", "b", lambda x, b: F.rint((x - b["lo"]) / (b["hi"] - b["lo"]) * 255) / 255 * (b["hi"] - b["lo"]) + b["lo"])
    return listed(retrieval.knn(query_vectors(g), g.join(F.broadcast(bounds)).withColumn("vector", back), 10))


HALF_SQL = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x * pow(2.0, 10 - greatest(floor(log2(abs(x))), -14)), 0) / pow(2.0, 10 - greatest(floor(log2(abs(x))), -14)) END"


def half(x):
    """A number as a half float holds it: eleven significant bits, down to steps of 2^-24."""
    scale = F.pow(F.lit(2.0), 10 - F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)).cast("double"))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


@query("knn_half", f"WITH {RUNS_SQL}, h AS (SELECT vec_id, list_transform(u, lambda x: {HALF_SQL}) AS u FROM e), j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.u, d.u) AS s FROM h q, h d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) {_rank_sql('s', 'j')}")
def knn_half(spark, d):
    """Search over vectors rounded to half floats."""
    h = vectors(spark, d).withColumn("vector", F.transform("vector", half))
    return listed(retrieval.knn(query_vectors(h), h, 10))


# ---- lexical retrieval over the parts catalog; queries are the distinct (name, type) of every fiftieth part

PARTS_SQL = """
toks AS (SELECT p_partkey AS doc_id, f, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM (SELECT p_partkey, 1 AS f, p_name AS t FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part UNION ALL SELECT p_partkey, 3, p_brand FROM part)),
post AS (SELECT doc_id, f, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT doc_id, f, count(*) AS len FROM toks GROUP BY ALL),
avgs AS (SELECT f, avg(len) AS al FROM lens GROUP BY f),
dfs AS (SELECT f, term, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS term FROM part WHERE p_partkey % 50 = 0) GROUP BY ALL),
fs AS (SELECT q.query_id, p.doc_id, p.f, sum(q.qtf * ln(1 + ((SELECT count(*) FROM part) - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.len / a.al))) * CASE p.f WHEN 1 THEN 4.0 WHEN 2 THEN 3.0 ELSE 2.0 END AS s
  FROM qt q JOIN post p ON p.term = q.term JOIN dfs d ON d.f = p.f AND d.term = p.term JOIN lens l ON l.doc_id = p.doc_id AND l.f = p.f JOIN avgs a ON a.f = p.f GROUP BY q.query_id, p.doc_id, p.f),
bf AS (SELECT query_id, doc_id, max(s) + 0.3 * (sum(s) - max(s)) AS score FROM fs GROUP BY ALL)
"""


def _parts(spark, d, alike=None, boost=1.0, k=10):
    """Parts equal in name, type and brand are scored once, as are queries that ask the same."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type", "p_brand")
    asked = p.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    queries, q_of = retrieval.grouped(asked, "query_id", ["p_name", "p_type", *["p_brand"] * bool(alike)], None)
    docs, d_of = retrieval.grouped(p, "doc_id", ["p_name", "p_type", "p_brand"], k)
    brand = F.col("p_brand") if alike else F.lit(None).cast("string")
    words = tokens(F.concat("p_name", F.lit(" "), "p_type"))
    found = retrieval.bm25_topk(
        queries.select("query_id", brand.alias("attribute"), words.alias("words")), docs.select("doc_id", "n", brand.alias("attribute"), *[tokens(F.col(c)).alias(f"words_{f}") for f, c in enumerate(("p_name", "p_type", "p_brand"))]),
        [4.0, 3.0, 2.0], k, alike=alike, boost=boost,
    )
    return listed(retrieval.expanded(found.drop("rank"), q_of, d_of, k))


@query("bm25_fielded_best_fields", f"WITH {PARTS_SQL} {_rank_sql('score', 'bf')}")
def bm25_fielded(spark, d):
    return _parts(spark, d)


BRAND_SQL = "brand AS (SELECT q.p_partkey AS query_id, x.p_partkey AS doc_id FROM part q JOIN part x USING (p_brand) WHERE q.p_partkey % 50 = 0)"


@query("bm25_bool_should", f"WITH {PARTS_SQL}, {BRAND_SQL}, j AS (SELECT bf.*, CASE WHEN brand.doc_id IS NULL THEN 0.0 ELSE 2.0 END AS x FROM bf LEFT JOIN brand USING (query_id, doc_id)) {_rank_sql('score + x', 'j')}")
def bm25_should(spark, d):
    return _parts(spark, d, "should", 2.0)


@query("bm25_function_score", f"WITH {PARTS_SQL}, {BRAND_SQL}, j AS (SELECT bf.*, CASE WHEN brand.doc_id IS NULL THEN 1.0 ELSE 1.5 END AS x FROM bf LEFT JOIN brand USING (query_id, doc_id)) {_rank_sql('score * x', 'j')}")
def bm25_function(spark, d):
    return _parts(spark, d, "function", 1.5)


@query("bm25", """WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL), lens AS (SELECT doc_id, count(*) AS len FROM toks GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT q.query_id, p.doc_id, sum(q.qtf * ln(1 + ((SELECT count(*) FROM documents) - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.len / (SELECT avg(len) FROM lens)))) AS score
  FROM qt q JOIN post p ON p.term = q.term JOIN dfs d ON d.term = p.term JOIN lens l ON l.doc_id = p.doc_id GROUP BY q.query_id, p.doc_id) """ + _rank_sql("score", "r"))
def bm25(spark, d):
    """Benchmark passages against all documents."""
    none = F.lit(None).cast("string").alias("attribute")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), none, tokens(F.col("text")).alias("words"))
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("n"), none, tokens(F.col("text")).alias("words_0"))
    return listed(retrieval.bm25_topk(queries, docs, [1.0], 10))


@query("sparse_dot", f"WITH {RUNS_SQL}, p AS (SELECT vec_id, i AS term, u[i] AS w FROM e, range(1, 65) t(i) WHERE u[i] > 0.1), r AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, sum(q.w * x.w) AS score FROM p q JOIN p x ON q.term = x.term WHERE q.vec_id % 50 = 0 GROUP BY ALL) {_rank_sql('score', 'r')}")
def sparse_dot(spark, d):
    p = vectors(spark, d).select("doc_id", F.posexplode("vector").alias("term", "weight")).where("weight > 0.1")
    return listed(retrieval.sparse_topk(p.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"), p, 10))


# ---- fusion

RRF = "SELECT query_id, doc_id, round(sum({a}), 10) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(sum({a}), 10) DESC, doc_id))::INT AS rank FROM ({parts}) GROUP BY query_id, doc_id QUALIFY rank <= 10"


@query("rrf_two", f"WITH {RUNS_SQL} " + RRF.format(a="p", parts="SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) AS p FROM run_a UNION ALL SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) FROM run_b"))
def rrf_two(spark, d):
    return listed(fusion.rrf([(run_full(spark, d), 0.4), (run_prefix(spark, d), 0.6)], top=10))


@query("rrf_truncated", f"WITH {RUNS_SQL} " + RRF.format(a="p", parts="SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM run_a WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM run_b WHERE rank <= 20"))
def rrf_truncated(spark, d):
    return listed(fusion.rrf([(run_full(spark, d), 1.0), (run_prefix(spark, d), 1.0)], top=10, depth=20))


@query("score_mean_fusion", f"WITH {RUNS_SQL}, j AS (SELECT query_id, doc_id, 0.4 * a.score + 0.6 * b.score AS s FROM run_a a JOIN run_b b USING (query_id, doc_id)) {_rank_sql('s', 'j')}")
def score_mean(spark, d):
    return listed(fusion.mixed_scores(run_full(spark, d), run_prefix(spark, d), 0.4, 10))


@query("zscore_rerank", f"""WITH {RUNS_SQL}, ca AS (SELECT * FROM run_a WHERE rank <= 50), cb AS (SELECT b.* FROM run_b b JOIN ca USING (query_id, doc_id)),
za AS (SELECT query_id, doc_id, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS z FROM ca WINDOW w AS (PARTITION BY query_id)), zb AS (SELECT query_id, doc_id, CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0.0 END AS z FROM cb WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT za.query_id, za.doc_id, za.z + coalesce(zb.z, 0.0) AS s FROM za LEFT JOIN zb USING (query_id, doc_id)) {_rank_sql('s', 'j', 50)}""")
def zscore(spark, d):
    return listed(fusion.z_rerank(run_full(spark, d), run_prefix(spark, d), 50))


@query("weight_sweep_best", f"""WITH {RUNS_SQL}, j AS (SELECT query_id, doc_id, a.score AS sa, b.score AS sb, a.grade FROM run_a a JOIN run_b b USING (query_id, doc_id)),
s AS (SELECT w, query_id, doc_id, grade, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * sa + (1 - w) * sb, 6) DESC, doc_id) AS rank FROM j, (VALUES (0.0::DOUBLE), (0.2), (0.4), (0.6), (0.8), (1.0)) t(w))
SELECT w AS weight, round(avg(p), 6) AS precision_10 FROM (SELECT w, query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM s GROUP BY ALL) GROUP BY w""")
def weight_sweep(spark, d):
    a, b = run_full(spark, d), run_prefix(spark, d).select("query_id", "doc_id", F.col("score").alias("sb"))
    both = a.join(b, ["query_id", "doc_id"]).withColumn("weight", F.explode(F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))))
    s = both.withColumn("s", F.round(F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("sb"), 6))
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("s"), "doc_id")))
    per = s.groupBy("weight", "query_id").agg((F.sum(F.when(F.col("r") <= 10, F.col("grade")).otherwise(0)) / 10.0).alias("p"))
    return per.groupBy("weight").agg(F.round(F.avg("p"), 6).alias("precision_10"))


@query("softmax_listwise", f"WITH {RUNS_SQL}, x AS (SELECT query_id, doc_id, exp((score - max(score) OVER w) / 0.1) AS ex FROM run_a WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(ex / sum(ex) OVER (PARTITION BY query_id), 6) AS p FROM x")
def softmax_listwise(spark, d):
    return fusion.softmax(run_full(spark, d), 0.1).select("query_id", "doc_id", F.round("p", 6).alias("p"))


# ---- metrics

def per_query(frame, column, name):
    return frame.select("query_id", F.round(column, 6).alias(name))


@query("ndcg_linear", f"""WITH {RUNS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM run_a),
s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN grade / log2(best + 1) ELSE 0 END) AS idcg FROM b GROUP BY query_id)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg_linear(spark, d):
    return per_query(metrics.ndcg(run_full(spark, d), 10), "ndcg", "ndcg")


@query("ndcg_binary_fixed", f"WITH {RUNS_SQL} SELECT query_id, round(sum(CASE WHEN rank <= 5 THEN grade / log2(rank + 1) ELSE 0 END) / (1 / log2(2) + 1 / log2(3) + 1 / log2(4) + 1 / log2(5) + 1 / log2(6)), 6) AS ndcg FROM run_a GROUP BY query_id")
def ndcg_fixed(spark, d):
    return per_query(metrics.ndcg_binary_fixed(run_full(spark, d)), "ndcg", "ndcg")


@query("ndcg_exp_gain", f"WITH {RUNS_SQL} SELECT query_id, round(sum(CASE WHEN rank <= 5 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(5, n_rel) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM run_a JOIN rel USING (query_id) GROUP BY query_id, n_rel")
def ndcg_exp(spark, d):
    g = vectors(spark, d)
    return per_query(metrics.ndcg_exponential(run_full(spark, d), relevant(g)), "ndcg", "ndcg")


@query("recall_precision", f"""WITH {RUNS_SQL} SELECT query_id, round(coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0), 6) AS mrr, round(sum(CASE WHEN rank <= 5 THEN grade ELSE 0 END) / n_rel, 6) AS recall_5, round(sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / n_rel, 6) AS recall_10,
round(sum(CASE WHEN rank <= 5 THEN grade ELSE 0 END) / 5, 6) AS precision_5, round(sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10, 6) AS precision_10, max(CASE WHEN rank <= 5 THEN grade ELSE 0 END)::INT AS hit_5, max(CASE WHEN rank <= 10 THEN grade ELSE 0 END)::INT AS hit_10 FROM run_a JOIN rel USING (query_id) GROUP BY query_id, n_rel""")
def recall_precision(spark, d):
    m = metrics.hit_metrics(run_full(spark, d), relevant(vectors(spark, d)))
    return m.select("query_id", "hit_5", "hit_10", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id" and not c.startswith("hit")])


def _ap_sql(cut, denominator):
    return f"WITH {RUNS_SQL}, h AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM run_a WHERE rank <= {cut}) SELECT query_id, round(sum(CASE WHEN grade > 0 THEN hits::DOUBLE / rank ELSE 0 END) / {denominator}, 6) AS ap FROM h JOIN rel USING (query_id) GROUP BY query_id, n_rel"


def _ap(name, cut, denominator, sql):
    @query(name, _ap_sql(cut, sql))
    def ap(spark, d):
        return per_query(metrics.average_precision(run_full(spark, d), relevant(vectors(spark, d)), cut, denominator), "ap", "ap")


_ap("average_precision", 100, "all", "n_rel")
_ap("map10_min_k", 10, "min_k", "least(n_rel, 10)")
_ap("map10_all", 10, "all", "n_rel")


@query("gold_rank", f"WITH {RUNS_SQL} SELECT query_id, coalesce(min(CASE WHEN grade > 0 THEN rank END), 101)::INT AS first_rank FROM run_b GROUP BY query_id")
def gold_rank(spark, d):
    return metrics.first_hit(run_prefix(spark, d)).select("query_id", F.col("first_rank").cast("int").alias("first_rank"))


@query("ndcg_macro", f"WITH {RUNS_SQL} SELECT round(avg(h), 6) AS hit_10, count(*) AS n_queries FROM (SELECT query_id, max(CASE WHEN rank <= 10 THEN grade ELSE 0 END) AS h FROM run_a GROUP BY query_id)")
def macro(spark, d):
    m = metrics.hit_metrics(run_full(spark, d), relevant(vectors(spark, d)))
    return metrics.macro(m, ["hit_10"]).select(F.round("hit_10", 6).alias("hit_10"), "n_queries")


@query("diagonal_rank", f"WITH {RUNS_SQL}, p AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_inner_product(q.u[1:32], x.u[33:64]), 6) AS s FROM e q, e x WHERE q.vec_id % 50 = 0) SELECT a.query_id, (1 + count(*) FILTER (a.s > b.s))::INT AS rank FROM p a JOIN p b ON a.query_id = b.query_id AND b.query_id = b.doc_id GROUP BY a.query_id")
def diagonal_rank(spark, d):
    """Texts (first half of a vector) of the query set against all images (second half): the own image's rank, from counts of higher scores a task."""
    g = vectors(spark, d)
    images = g.select("doc_id", F.slice("vector", 33, 32).alias("vector"))
    texts = query_vectors(g).select("query_id", F.slice("vector", 1, 32).alias("vector"), F.round(dot(F.slice("vector", 1, 32), F.slice("vector", 33, 32)), 6).alias("own"))
    return retrieval.higher_counts(texts, images).select("query_id", (F.col("higher") + 1).cast("int").alias("rank"))


@query("weighted_overall", f"WITH {RUNS_SQL}, s AS (SELECT q.label, avg(grade) AS m, count(*) AS n FROM run_a r JOIN e q ON q.vec_id = r.query_id WHERE rank <= 10 GROUP BY q.label) SELECT round(sum(m * n) / sum(n), 6) AS overall FROM s")
def weighted(spark, d):
    g = vectors(spark, d).select(F.col("doc_id").alias("query_id"), "label")
    per = run_full(spark, d).where("rank <= 10").join(g, "query_id").groupBy("label").agg(F.avg("grade").alias("m"), F.count("*").alias("n"))
    return metrics.weighted_overall(per, "m", "n").select(F.round("overall", 6).alias("overall"))


@query("flagship_hybrid", f"WITH {RUNS_SQL}, f AS (" + RRF.format(a="p", parts="SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) AS p FROM run_a UNION ALL SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) FROM run_b") + ") SELECT round(avg(h), 6) AS hit_10, count(*) AS n_queries FROM (SELECT f.query_id, max((q.label = x.label)::INT) AS h FROM f JOIN e q ON q.vec_id = f.query_id JOIN e x ON x.vec_id = f.doc_id GROUP BY f.query_id)")
def flagship(spark, d):
    g = vectors(spark, d)
    fused = labelled(fusion.rrf([(run_full(spark, d), 0.4), (run_prefix(spark, d), 0.6)], top=10), g)
    m = metrics.hit_metrics(fused, relevant(g))
    return metrics.macro(m, ["hit_10"]).select(F.round("hit_10", 6).alias("hit_10"), "n_queries")


@query("token_overlap_run", "WITH p AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t FROM part), x AS (SELECT id, unnest(t) AS term FROM p), j AS (SELECT q.id AS query_id, d.id AS doc_id, count(*)::DOUBLE AS s FROM x q JOIN x d USING (term) WHERE q.id % 50 = 0 AND q.id <> d.id GROUP BY ALL) " + _rank_sql("s", "j"))
def token_overlap(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array_distinct(tokens(F.col("p_name")))).alias("term")).withColumn("weight", F.lit(1.0))
    q = x.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    other = retrieval.sparse_topk(q, x, 11).where("query_id <> doc_id")
    return listed(retrieval.ranked(other.select("query_id", "doc_id", "score"), 10))
