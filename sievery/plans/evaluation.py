"""Queries of whole evaluation blocks, ablations, joins of results, diagnostics, projections and set builders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievery.functions import text as tx
from sievery.functions.vectors import composed, dot, unit
from sievery.operators import fusion, retrieval, sampling

from .base import RUNS_SQL, query, query_vectors, relevant, run_full, run_prefix, table, vectors
from .search import RRF, _rank_sql, listed

U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def within(k, value="grade"):
    return F.sum(F.when(F.col("rank") <= k, F.col(value)).otherwise(0))


# ---- evaluation blocks


@query("retrieval_block", f"""WITH {RUNS_SQL}, h AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM run_a),
q AS (SELECT query_id, sum(CASE WHEN rank <= 10 AND grade > 0 THEN hits::DOUBLE / rank ELSE 0 END) / least(max(n_rel), 10) AS ap, max(CASE WHEN rank = 1 THEN grade ELSE 0 END) AS r1, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / max(n_rel) AS r10, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p10, coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0) AS rr FROM h JOIN rel USING (query_id) GROUP BY query_id)
SELECT count(*) AS n, round(avg(ap), 6) AS map_10, round(avg(r1), 6) AS recall_1, round(avg(r10), 6) AS recall_10, round(avg(p10), 6) AS precision_10, round(avg(rr), 6) AS mrr FROM q""")
def retrieval_block(spark, d):
    """MAP@10 over the lesser of relevant and 10, R@1 as a hit, R@10 as a share, P@10 and MRR in one pass over the run."""
    w = Window.partitionBy("query_id").orderBy("rank")
    run = run_full(spark, d).withColumn("hits", F.sum("grade").over(w)).join(relevant(vectors(spark, d)), "query_id")
    ap = F.sum(F.when((F.col("rank") <= 10) & (F.col("grade") > 0), F.col("hits") / F.col("rank")).otherwise(0.0)) / F.least(F.max("n_rel"), F.lit(10))
    rr = F.coalesce(1.0 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0))
    per = run.groupBy("query_id").agg(ap.alias("map_10"), within(1).alias("recall_1"), (within(10) / F.max("n_rel")).alias("recall_10"), (within(10) / 10.0).alias("precision_10"), rr.alias("mrr"))
    return per.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in per.columns if c != "query_id"])


@query("retrieval_block_hits", f"WITH {RUNS_SQL}, q AS (SELECT query_id, max(CASE WHEN rank <= 10 THEN grade ELSE 0 END) AS h, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END)::DOUBLE / count(*) FILTER (rank <= 10) AS p FROM run_b GROUP BY query_id) SELECT round(avg(h), 6) AS recall_10, round(avg(p), 6) AS precision_10 FROM q")
def retrieval_block_hits(spark, d):
    """The other block's conventions: R@10 as a hit, P@10 over what was returned."""
    per = run_prefix(spark, d).groupBy("query_id").agg(F.max(F.when(F.col("rank") <= 10, F.col("grade")).otherwise(0)).alias("h"), (within(10) / F.count_if(F.col("rank") <= 10)).alias("p"))
    return per.agg(F.round(F.avg("h"), 6).alias("recall_10"), F.round(F.avg("p"), 6).alias("precision_10"))


GRADES_SQL = RUNS_SQL + ", gr AS (SELECT r.query_id, r.rank, (q.label = x.label)::INT AS fine, (q.label % 5 = x.label % 5)::INT AS coarse, (q.label // 2 = x.label // 2)::INT AS half FROM run_a r JOIN e q ON q.vec_id = r.query_id JOIN e x ON x.vec_id = r.doc_id)"


@query("graded_recall", f"WITH {GRADES_SQL} SELECT k::INT AS k, round(100 * avg(f), 2) AS fine, round(100 * avg(c), 2) AS coarse, round(100 * avg(h), 2) AS half FROM (SELECT k, query_id, max(CASE WHEN rank <= k THEN fine ELSE 0 END) AS f, max(CASE WHEN rank <= k THEN coarse ELSE 0 END) AS c, max(CASE WHEN rank <= k THEN half ELSE 0 END) AS h FROM gr, (VALUES (1), (5), (10), (20)) t(k) GROUP BY ALL) GROUP BY k")
def graded_recall(spark, d):
    """Recall at 1, 5, 10 and 20 in percent by three gradings of one run: equal labels and two coarser classes of them."""
    g = vectors(spark, d).select("doc_id", "label")
    q = g.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql"))
    same = lambda f: (f(F.col("ql")) == f(F.col("label"))).cast("int")
    run = run_full(spark, d).join(g, "doc_id").join(q, "query_id").select("query_id", "rank", same(lambda x: x).alias("fine"), same(lambda x: x % 5).alias("coarse"), same(lambda x: F.floor(x / 2)).alias("half"))
    per = run.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10, 20))))).groupBy("k", "query_id").agg(*[F.max(F.when(F.col("rank") <= F.col("k"), F.col(c)).otherwise(0)).alias(c) for c in ("fine", "coarse", "half")])
    return per.groupBy("k").agg(*[F.round(100 * F.avg(c), 2).alias(c) for c in ("fine", "coarse", "half")])


@query("id_recall", f"WITH {RUNS_SQL}, p AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_inner_product(q.u[1:32], x.u[33:64]), 6) AS s FROM e q, e x WHERE q.vec_id % 50 = 0), r AS (SELECT a.query_id, 1 + count(*) FILTER (a.s > b.s) AS rank FROM p a JOIN p b ON a.query_id = b.query_id AND b.query_id = b.doc_id GROUP BY a.query_id) SELECT round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 10)::INT), 6) AS r10, round(avg((rank <= 100)::INT), 6) AS r100, round(100 * avg(1.0 / rank), 6) AS mrr FROM r")
def id_recall(spark, d):
    """Recall by id and full-rank MRR in percent: text side against all images, own id only."""
    g = vectors(spark, d)
    texts = query_vectors(g).select("query_id", F.slice("vector", 1, 32).alias("vector"), F.round(dot(F.slice("vector", 1, 32), F.slice("vector", 33, 32)), 6).alias("own"))
    r = retrieval.higher_counts(texts, g.select("doc_id", F.slice("vector", 33, 32).alias("vector"))).withColumn("rank", F.col("higher") + 1)
    return r.agg(*[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"r{k}") for k in (1, 10, 100)], F.round(100 * F.avg(1.0 / F.col("rank")), 6).alias("mrr"))


@query("mrr", f"WITH {RUNS_SQL} SELECT query_id, round(coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0), 6) AS mrr FROM run_b GROUP BY query_id")
def mrr(spark, d):
    return run_prefix(spark, d).groupBy("query_id").agg(F.round(F.coalesce(1.0 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


@query("triplet_accuracy", f"WITH {RUNS_SQL}, t AS (SELECT a.vec_id AS anchor, list_inner_product(a.u, p.u) AS pos, list_inner_product(a.u, n.u) AS neg FROM e a JOIN e p ON p.vec_id = a.vec_id + 1 JOIN e n ON n.vec_id = a.vec_id + 2 WHERE a.label = p.label AND a.label <> n.label) SELECT count(*) AS n, round(avg((pos > neg)::INT), 6) AS accuracy FROM t")
def triplet_accuracy(spark, d):
    """Of triplets (row, next row of its label, the one after of another), how often the positive is nearer."""
    g = vectors(spark, d)
    side = lambda n, by: g.select((F.col("doc_id") - by).alias("doc_id"), F.col("label").alias(f"{n}_label"), F.col("vector").alias(n))
    t = g.join(side("p", 1), "doc_id").join(side("n", 2), "doc_id").where("label = p_label AND label <> n_label")
    return t.agg(F.count("*").alias("n"), F.round(F.avg((dot(F.col("vector"), F.col("p")) > dot(F.col("vector"), F.col("n"))).cast("int")), 6).alias("accuracy"))


# ---- fusion and ablation


@query("rrf_three", f"WITH {RUNS_SQL}, short8 AS (SELECT vec_id, label, list_transform(u[1:8], lambda x: x / sqrt(list_inner_product(u[1:8], u[1:8]))) AS u FROM e), run_c AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.u, d.u), 6) DESC, d.vec_id) AS rank FROM short8 q, short8 d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id QUALIFY rank <= 100) " + RRF.format(a="p", parts="SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) AS p FROM run_a UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM run_b UNION ALL SELECT query_id, doc_id, 0.2::DOUBLE / (60 + rank) FROM run_c"))
def rrf_three(spark, d):
    return listed(fusion.rrf([(run_full(spark, d), 0.3), (run_prefix(spark, d), 0.5), (run_prefix(spark, d, 100, 8), 0.2)], top=10))


NDCG_SQL = "sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN grade / log2(b + 1) ELSE 0 END) AS idcg"


@query("weight_sweep_ndcg", f"""WITH {RUNS_SQL}, j AS (SELECT query_id, doc_id, a.score AS sa, b.score AS sb, a.grade FROM run_a a JOIN run_b b USING (query_id, doc_id)),
s AS (SELECT w, query_id, grade, row_number() OVER (PARTITION BY w, query_id ORDER BY round(w * sa + (1 - w) * sb, 6) DESC, doc_id) AS r, row_number() OVER (PARTITION BY w, query_id ORDER BY grade DESC, doc_id) AS b FROM j, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w)),
n AS (SELECT w, query_id, {NDCG_SQL} FROM s GROUP BY ALL), m AS (SELECT w AS weight, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_10 FROM n GROUP BY w) SELECT *, (row_number() OVER (ORDER BY ndcg_10 DESC, weight) = 1) AS best FROM m""")
def weight_sweep_ndcg(spark, d):
    """Convex weights by nDCG@10 over the candidates of both runs, the best one marked (of equal ones the least weight)."""
    b = run_prefix(spark, d).select("query_id", "doc_id", F.col("score").alias("sb"))
    both = run_full(spark, d).join(b, ["query_id", "doc_id"]).withColumn("weight", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    w = Window.partitionBy("weight", "query_id")
    s = both.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("sb"), 6)), "doc_id"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("grade"), "doc_id")))
    gain = lambda c: F.sum(F.when(F.col(c) <= 10, F.col("grade") / F.log2(F.col(c) + 1)).otherwise(0.0))
    n = s.groupBy("weight", "query_id").agg(gain("r").alias("dcg"), gain("b").alias("idcg"))
    m = n.groupBy("weight").agg(F.round(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), 6).alias("ndcg_10"))
    return m.withColumn("best", F.row_number().over(Window.orderBy(F.desc("ndcg_10"), "weight")) == 1)  # a row a weight


@query("ablation", f"WITH {RUNS_SQL}, r AS (SELECT 'full' AS run, * FROM run_a UNION ALL SELECT 'prefix', * FROM run_b), p AS (SELECT run, query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM r GROUP BY ALL) SELECT run, count(*) AS n, round(avg(p), 6) AS precision_10, round(avg(p) - 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS lo, round(avg(p) + 1.96 * stddev_samp(p) / sqrt(count(*)), 6) AS hi FROM p GROUP BY run")
def ablation(spark, d):
    """Named runs with a metric and its interval of the mean."""
    runs = run_full(spark, d).withColumn("run", F.lit("full")).unionByName(run_prefix(spark, d).withColumn("run", F.lit("prefix")))
    per = runs.groupBy("run", "query_id").agg((within(10) / 10.0).alias("p"))
    half = 1.96 * F.stddev_samp("p") / F.sqrt(F.count("*"))
    return per.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision_10"), F.round(F.avg("p") - half, 6).alias("lo"), F.round(F.avg("p") + half, 6).alias("hi"))


@query("augmented_average", f"WITH {RUNS_SQL}, w AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (u[i] + u[65 - i]) / 2) AS w FROM e), c AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM w), j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_inner_product(q.u, d.u) AS s FROM c q, c d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) {_rank_sql('s', 'j')}")
def augmented_average(spark, d):
    """Search over the average of a vector and a changed copy of it (here: reversed), made unit again."""
    c = vectors(spark, d).withColumn("vector", composed([(F.col("vector"), 0.5), (F.reverse("vector"), 0.5)]))
    return listed(retrieval.knn(query_vectors(c), c, 10))


@query("listnet_loss", f"WITH {RUNS_SQL}, x AS (SELECT query_id, grade, ln(exp(score / 0.1) / sum(exp(score / 0.1)) OVER w) AS lp, exp(grade) / sum(exp(grade)) OVER w AS t FROM run_a WINDOW w AS (PARTITION BY query_id)) SELECT round(avg(l), 6) AS loss FROM (SELECT query_id, -sum(t * lp) AS l FROM x GROUP BY query_id)")
def listnet_loss(spark, d):
    w = Window.partitionBy("query_id")
    x = run_full(spark, d).select("query_id", (F.col("score") / 0.1 - F.ln(F.sum(F.exp(F.col("score") / 0.1)).over(w))).alias("lp"), (F.exp("grade") / F.sum(F.exp("grade")).over(w)).alias("t"))
    return x.groupBy("query_id").agg((-F.sum(F.col("t") * F.col("lp"))).alias("l")).agg(F.round(F.avg("l"), 6).alias("loss"))


@query("uniformity", f"WITH {RUNS_SQL}, x AS (SELECT 2 - 2 * list_inner_product(q.u, d.u) AS d2 FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) SELECT round(ln(avg(exp(-2 * d2))), 6) AS uniformity FROM x")
def uniformity(spark, d):
    """log mean exp(-2 d^2) of the query set against all vectors, from one sum a query and task."""
    g = vectors(spark, d)
    sums = retrieval.sums_of(query_vectors(g), g, lambda s: np.exp(4 * s - 4))
    return sums.agg(F.round(F.ln(F.sum("s") / F.sum("n")), 6).alias("uniformity"))


# ---- joins of results


@query("category_vectors", f"WITH {RUNS_SQL}, c AS (SELECT label, i, avg(u[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL), v AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label) SELECT e.vec_id AS doc_id, round(list_inner_product(u, m) / sqrt(list_inner_product(m, m)), 6) AS similarity FROM e JOIN v USING (label)")
def category_vectors(spark, d):
    """Each item takes its category's vector; a category's mean is made of 64 sums, the join is on the category."""
    g = vectors(spark, d)
    c = g.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    v = c.groupBy("label").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("c"))
    return g.join(v, "label").select("doc_id", F.round(dot(F.col("vector"), F.col("c")), 6).alias("similarity"))


@query("original_ids", "WITH s AS (SELECT doc_id::VARCHAR || '_syn' || (doc_id % 3)::VARCHAR AS sid FROM documents UNION ALL SELECT 'x' || doc_id::VARCHAR || '_syn0' FROM documents WHERE doc_id % 10 = 0) SELECT sid, doc_id FROM s JOIN documents ON doc_id::VARCHAR = regexp_replace(sid, '_syn[0-9]+$', '')")
def original_ids(spark, d):
    """Synthetic ids joined to their originals by stripping the suffix; orphans are dropped."""
    docs = table(spark, d, "documents").select("doc_id")
    s = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_syn"), (F.col("doc_id") % 3).cast("string")).alias("sid"))
    s = s.unionByName(docs.where("doc_id % 10 = 0").select(F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit("_syn0")).alias("sid")))
    return s.withColumn("of", F.regexp_replace("sid", "_syn[0-9]+$", "")).join(docs.withColumn("of", F.col("doc_id").cast("string")), "of").select("sid", "doc_id")


@query("result_gaps", f"WITH {RUNS_SQL}, a AS (SELECT x.label AS benchmark, avg(r.grade) AS m FROM run_a r JOIN e x ON x.vec_id = r.query_id WHERE rank <= 10 GROUP BY 1), b AS (SELECT x.label AS benchmark, avg(r.grade) AS m FROM run_b r JOIN e x ON x.vec_id = r.query_id WHERE rank <= 10 GROUP BY 1) SELECT benchmark, round(a.m, 6) AS ours, round(b.m, 6) AS reference, round(a.m - b.m, 6) AS gap, round(CASE WHEN b.m <> 0 THEN 100 * (a.m - b.m) / b.m ELSE 0 END, 4) AS percent, (a.m >= b.m) AS met FROM a JOIN b USING (benchmark)")
def result_gaps(spark, d):
    """Results against reference results by benchmark: gap, percent, whether the target is met."""
    g = vectors(spark, d).select(F.col("doc_id").alias("query_id"), F.col("label").alias("benchmark"))
    mean = lambda run, n: run.where("rank <= 10").join(g, "query_id").groupBy("benchmark").agg(F.avg("grade").alias(n))
    j = mean(run_full(spark, d), "a").join(mean(run_prefix(spark, d), "b"), "benchmark")
    percent = F.when(F.col("b") != 0, 100 * (F.col("a") - F.col("b")) / F.col("b")).otherwise(0.0)
    return j.select("benchmark", F.round("a", 6).alias("ours"), F.round("b", 6).alias("reference"), F.round(F.col("a") - F.col("b"), 6).alias("gap"), F.round(percent, 4).alias("percent"), (F.col("a") >= F.col("b")).alias("met"))


# ---- diagnostics


@query("latency_quantiles", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_quantiles(spark, d):
    q = lambda p, n: F.round(F.expr(f"percentile(value, {p})"), 6).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), q(0.5, "p50"), q(0.95, "p95"))


@query("text_profile_full", "SELECT lang, count(*) AS n, round(avg((text IS NULL OR trim(text) = '')::INT), 6) AS null_rate, count(DISTINCT text) AS distinct_texts, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(quantile_cont(length(text), 0.5), 6) AS median_chars, round(quantile_cont(length(text), 0.1), 6) AS p10_chars FROM documents GROUP BY lang")
def text_profile_full(spark, d):
    t = table(spark, d, "documents").withColumn("c", F.length("text"))
    q = lambda p, n: F.round(F.expr(f"percentile(c, {p})"), 6).alias(n)
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("text").isNull() | (F.trim("text") == "")).cast("int")), 6).alias("null_rate"), F.countDistinct("text").alias("distinct_texts"), F.min("c").cast("long").alias("min_chars"), F.max("c").cast("long").alias("max_chars"), q(0.5, "median_chars"), q(0.1, "p10_chars"))


@query("bucketed_metrics", f"WITH {RUNS_SQL} SELECT CASE WHEN label < 3 THEN 'low' WHEN label < 7 THEN 'mid' ELSE 'high' END AS bucket, (query_id % 100 = 0) AS flag, count(*) AS n, round(avg(p), 6) AS precision_10 FROM (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM run_a GROUP BY 1) JOIN e ON vec_id = query_id GROUP BY ALL")
def bucketed_metrics(spark, d):
    g = vectors(spark, d).select(F.col("doc_id").alias("query_id"), "label")
    per = run_full(spark, d).groupBy("query_id").agg((within(10) / 10.0).alias("p")).join(g, "query_id")
    bucket = F.when(F.col("label") < 3, "low").when(F.col("label") < 7, "mid").otherwise("high")
    return per.groupBy(bucket.alias("bucket"), (F.col("query_id") % 100 == 0).alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision_10"))


@query("four_way_buckets", f"WITH {RUNS_SQL}, a AS (SELECT query_id, min(CASE WHEN grade > 0 THEN rank END) AS ra FROM run_a GROUP BY 1), b AS (SELECT query_id, min(CASE WHEN grade > 0 THEN rank END) AS rb FROM run_b GROUP BY 1) SELECT CASE WHEN coalesce(ra, 999) <= 3 AND coalesce(rb, 999) <= 3 THEN 'both_win' WHEN coalesce(ra, 999) <= 3 THEN 'a_only' WHEN coalesce(rb, 999) <= 3 THEN 'b_only' ELSE 'both_fail' END AS bucket, count(*) AS n, round(avg((coalesce(ra, 999) BETWEEN 4 AND 10)::INT), 6) AS near_miss_a FROM a JOIN b USING (query_id) GROUP BY 1")
def four_way_buckets(spark, d):
    first = lambda run, n: run.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(999)).alias(n))
    j = first(run_full(spark, d), "ra").join(first(run_prefix(spark, d), "rb"), "query_id")
    a, b = F.col("ra") <= 3, F.col("rb") <= 3
    return j.groupBy(F.when(a & b, "both_win").when(a, "a_only").when(b, "b_only").otherwise("both_fail").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("ra").between(4, 10).cast("int")), 6).alias("near_miss_a"))


@query("models_failed", f"WITH {RUNS_SQL}, r AS (SELECT 'a' AS m, * FROM run_a UNION ALL SELECT 'b', * FROM run_b), p AS (SELECT m, query_id, max(CASE WHEN rank <= 5 THEN grade ELSE 0 END) AS h, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM r GROUP BY ALL) SELECT query_id, sum(1 - h)::BIGINT AS failed, round(avg(p), 6) AS mean FROM p GROUP BY query_id")
def models_failed(spark, d):
    runs = run_full(spark, d).withColumn("m", F.lit("a")).unionByName(run_prefix(spark, d).withColumn("m", F.lit("b")))
    per = runs.groupBy("m", "query_id").agg(F.max(F.when(F.col("rank") <= 5, F.col("grade")).otherwise(0)).alias("h"), (within(10) / 10.0).alias("p"))
    return per.groupBy("query_id").agg(F.sum(1 - F.col("h")).cast("long").alias("failed"), F.round(F.avg("p"), 6).alias("mean"))


@query("gap_targets", f"WITH {RUNS_SQL} SELECT query_id, round(p, 6) AS p FROM (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM run_b GROUP BY 1) WHERE p < 0.3")
def gap_targets(spark, d):
    return run_prefix(spark, d).groupBy("query_id").agg(F.round(within(10) / 10.0, 6).alias("p")).where("p < 0.3")


@query("best_by_count", f"WITH {RUNS_SQL}, r AS (SELECT 'a' AS m, * FROM run_a UNION ALL SELECT 'b', * FROM run_b), p AS (SELECT m, label, round(avg(r.grade), 6) AS v FROM r JOIN e ON vec_id = query_id WHERE rank <= 10 GROUP BY ALL), w AS (SELECT label, arg_max(m, (v, CASE m WHEN 'a' THEN 1 ELSE 0 END)) AS m FROM p GROUP BY label) SELECT m AS model, count(*) AS best FROM w GROUP BY m")
def best_by_count(spark, d):
    """How many benchmarks each model is best on; of equal ones the first model."""
    g = vectors(spark, d).select(F.col("doc_id").alias("query_id"), "label")
    runs = run_full(spark, d).withColumn("m", F.lit("a")).unionByName(run_prefix(spark, d).withColumn("m", F.lit("b"))).where("rank <= 10").join(g, "query_id")
    p = runs.groupBy("m", "label").agg(F.round(F.avg("grade"), 6).alias("v"))
    return p.groupBy("label").agg(F.max_by("m", F.struct("v", (F.col("m") == "a").alias("x"))).alias("model")).groupBy("model").agg(F.count("*").alias("best"))


@query("coverage_gates", "SELECT count(*) FILTER (f >= 2) AS two_fields, count(*) FILTER (f >= 3) AS three_fields, (count(*) FILTER (f >= 2) >= 0.5 * count(*)) AS passed FROM (SELECT (p_size > 10)::INT + (p_retailprice > 1000)::INT + contains(p_name, 'blue')::INT + contains(p_type, 'A')::INT AS f FROM part)")
def coverage_gates(spark, d):
    f = sum([c.cast("int") for c in (F.col("p_size") > 10, F.col("p_retailprice") > 1000, F.contains("p_name", F.lit("blue")), F.contains("p_type", F.lit("A")))], F.lit(0))
    return table(spark, d, "part").select(f.alias("f")).agg(F.count_if(F.col("f") >= 2).alias("two_fields"), F.count_if(F.col("f") >= 3).alias("three_fields"), (F.count_if(F.col("f") >= 2) >= 0.5 * F.count("*")).alias("passed"))


@query("query_features", "SELECT doc_id, length(text) AS n_chars, len(string_split(text, ' ')) AS n_words, regexp_matches(text, '[0-9]') AS has_digit, contains(text, ',') AS has_comma, regexp_matches(text, '^[A-Z]') AS starts_upper, (text = upper(text)) AS all_upper, round(length(replace(text, ' ', ''))::DOUBLE / greatest(len(string_split(text, ' ')), 1), 6) AS mean_word FROM documents")
def query_features(spark, d):
    t, n = F.col("text"), F.size(F.split("text", " ", -1))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), n.cast("long").alias("n_words"), t.rlike("[0-9]").alias("has_digit"), F.contains(t, F.lit(",")).alias("has_comma"), t.rlike("^[A-Z]").alias("starts_upper"), (t == F.upper(t)).alias("all_upper"), F.round(F.length(F.replace(t, F.lit(" "), F.lit(""))) / F.greatest(n, F.lit(1)), 6).alias("mean_word"))


# ---- projections and predicates


@query("composite_keys", "SELECT p_partkey AS id, p_type || '|' || p_brand AS composite, md5(p_type || '|' || p_brand || '|' || p_partkey::VARCHAR) AS key FROM part")
def composite_keys(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_type", "p_brand").alias("composite"), F.md5(F.concat_ws("|", "p_type", "p_brand", F.col("p_partkey").cast("string"))).alias("key"))


@query("category_hierarchy", "SELECT id, split_part(path, '/', 1) AS cat1, nullif(split_part(path, '/', 2), '') AS cat2, string_split(path, '/')[-1] AS leaf FROM (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_type || '/' || p_brand || '/' || p_name ELSE p_type END AS path FROM part)")
def category_hierarchy(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.when(F.col("p_size") > 25, F.concat_ws("/", "p_type", "p_brand", "p_name")).otherwise(F.col("p_type")), "/").alias("x"))
    return p.select("id", F.col("x")[0].alias("cat1"), F.get("x", F.lit(1)).alias("cat2"), F.element_at("x", -1).alias("leaf"))


@query("structured_query", "SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN concat_ws(' ', split_part(p_name, ' ', 1), p_type, 'size ' || p_size::VARCHAR) ELSE substr(p_name, 1, 120) END AS q FROM part")
def structured_query(spark, d):
    p = table(spark, d, "part")
    made = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, made).otherwise(F.substring("p_name", 1, 120)).alias("q"))


@query("attribute_prompt", "SELECT p_partkey AS id, concat_ws(chr(10), '- name: ' || p_name, '- brand: ' || p_brand, CASE WHEN p_size > 20 THEN '- size: ' || p_size::VARCHAR END) AS block, concat_ws(', ', split_part(p_name, ' ', 1), p_type) AS caption FROM part")
def attribute_prompt(spark, d):
    p = table(spark, d, "part")
    line = lambda n, c: F.concat(F.lit(f"- {n}: "), c)
    block = F.concat_ws("\n", line("name", F.col("p_name")), line("brand", F.col("p_brand")), F.when(F.col("p_size") > 20, line("size", F.col("p_size").cast("string"))))
    return p.select(F.col("p_partkey").alias("id"), block.alias("block"), F.concat_ws(", ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type").alias("caption"))


@query("keyword_predicate", "SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'licen[cs]e|src1')")
def keyword_predicate(spark, d):
    return table(spark, d, "documents").where(F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))).rlike("licen[cs]e|src1")).select("doc_id")


@query("word_count_filter", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) >= 10")
def word_count_filter(spark, d):
    return table(spark, d, "documents").where(tx.word_count(F.col("text")) >= 10).select("doc_id")


@query("top_classes", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 10) SELECT p_partkey AS id, p_brand AS class FROM part JOIN t USING (p_brand)")
def top_classes(spark, d):
    p = table(spark, d, "part")
    t = p.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "p_brand").limit(10)
    return p.join(F.broadcast(t.select("p_brand")), "p_brand").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class"))


# ---- builders


@query("pointwise_pairs", f"WITH {RUNS_SQL}, p AS (SELECT query_id, doc_id, 1 AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM run_a WHERE grade > 0) WHERE r <= 1), n AS (SELECT query_id, doc_id, 0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM run_a WHERE grade <= 0) WHERE r <= 5) SELECT * FROM p UNION ALL SELECT * FROM n")
def pointwise_pairs(spark, d):
    """For each query its best positive and up to five of its hardest negatives, with labels."""
    run = run_full(spark, d)
    part = lambda cond, n, y: sampling.per_group(run.where(cond), ["query_id"], n, ["rank"]).select("query_id", "doc_id", F.lit(y).alias("y"))
    return part("grade > 0", 1, 1).unionByName(part("grade <= 0", 5, 0))


@query("length_stratified_sample", "WITH b AS (SELECT doc_id, CASE WHEN w <= 100 THEN 'short' WHEN w <= 400 THEN 'medium' ELSE 'long' END AS bucket FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM documents)) SELECT doc_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('8|' || doc_id::VARCHAR), doc_id) AS r FROM b) WHERE r <= CASE bucket WHEN 'short' THEN 25 WHEN 'medium' THEN 35 ELSE 40 END")
def length_stratified(spark, d):
    """25, 35 and 40 % of 100 by length; each bucket is cut at a constant before its shuffle."""
    b = table(spark, d, "documents").select("doc_id", tx.length_bucket(tx.word_count(F.col("text")), 100, 400).alias("bucket"))
    parts = [sampling.per_group(b.where(F.col("bucket") == n), ["bucket"], k, sampling.shuffled(8, "doc_id")) for n, k in (("short", 25), ("medium", 35), ("long", 40))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("category_truth", "SELECT p_type AS query, p_partkey AS doc_id, 1 AS grade FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 HAVING count(*) >= 2)")
def category_truth(spark, d):
    """Each category value is a query, all its items are relevant; categories of one item are left out."""
    p = table(spark, d, "part").select(F.col("p_type").alias("query"), F.col("p_partkey").alias("doc_id"), F.lit(1).alias("grade"))
    return p.join(p.groupBy("query").count().where("count >= 2").select("query"), "query", "left_semi")


@query("rank_disagreement_triplets", f"WITH {RUNS_SQL}, j AS (SELECT query_id, doc_id, a.rank AS ra, coalesce(b.rank, 101) AS rb FROM run_a a LEFT JOIN run_b b USING (query_id, doc_id)), p AS (SELECT * FROM j WHERE ra <= 20 AND rb > 50 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ra) <= 3), n AS (SELECT * FROM j WHERE ra > 50 AND rb <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rb) <= 3) SELECT p.query_id, p.doc_id AS positive, n.doc_id AS negative FROM p JOIN n USING (query_id)")
def rank_disagreement(spark, d):
    """What the teacher ranks high and the student low, against the reverse: at most nine a query."""
    b = run_prefix(spark, d).select("query_id", "doc_id", F.col("rank").alias("rb"))
    j = run_full(spark, d).select("query_id", "doc_id", F.col("rank").alias("ra")).join(b, ["query_id", "doc_id"], "left").withColumn("rb", F.coalesce("rb", F.lit(101)))
    p = sampling.per_group(j.where("ra <= 20 AND rb > 50"), ["query_id"], 3, ["ra"]).select("query_id", F.col("doc_id").alias("positive"))
    n = sampling.per_group(j.where("ra > 50 AND rb <= 20"), ["query_id"], 3, ["rb"]).select("query_id", F.col("doc_id").alias("negative"))
    return p.join(n, "query_id")


@query("exploded_captions", "SELECT p_partkey::VARCHAR || '_' || (i - 1)::VARCHAR AS pair_id, c[i] AS caption FROM (SELECT p_partkey, list_filter(['a ' || p_name, CASE WHEN p_size > 25 THEN 'a large ' || p_name END, p_brand || ' ' || p_name], lambda x: x IS NOT NULL) AS c FROM part), range(1, 4) t(i) WHERE i <= len(c)")
def exploded_captions(spark, d):
    p = table(spark, d, "part")
    c = F.array_compact(F.array(F.concat(F.lit("a "), "p_name"), F.when(F.col("p_size") > 25, F.concat(F.lit("a large "), "p_name")), F.concat_ws(" ", "p_brand", "p_name")))
    return p.select("p_partkey", F.posexplode(c).alias("i", "caption")).select(F.concat_ws("_", F.col("p_partkey").cast("string"), F.col("i").cast("string")).alias("pair_id"), "caption")


@query("unique_text_sample", "SELECT doc_id FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 15 GROUP BY text) ORDER BY md5('12|' || doc_id::VARCHAR), doc_id LIMIT 50")
def unique_text_sample(spark, d):
    one = table(spark, d, "documents").where(F.length("text") >= 15).groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return one.select("doc_id").orderBy(*sampling.shuffled(12, "doc_id")).limit(50)


@query("first_appearance", "SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS at, count(*) AS n FROM events GROUP BY user_id")
def first_appearance(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("at"), F.count("*").alias("n"))


@query("reachable_articles", f"WITH {RUNS_SQL} SELECT DISTINCT doc_id FROM run_a WHERE {U.format('query_id::VARCHAR')} < 0.8 AND rank <= 20")
def reachable_articles(spark, d):
    """Articles that train queries reach as positives or negatives; the split is decided by the query's MD5."""
    from sievery.functions.text import hashed_unit

    run = run_full(spark, d).where("rank <= 20").where(hashed_unit(F.col("query_id").cast("string")) < 0.8)
    return run.select("doc_id").distinct()


@query("teacher_triplets", f"WITH {RUNS_SQL}, b AS (SELECT query_id, doc_id, rank FROM run_a WHERE rank <= 15), p AS (SELECT query_id, min(doc_id) AS x FROM b WHERE rank = 1 GROUP BY 1) SELECT b.query_id, p.x AS positive, b.doc_id AS negative FROM b JOIN p USING (query_id) WHERE b.rank > 1 AND b.rank <= 11")
def teacher_triplets(spark, d):
    """The nearest as positive, the ten after it as negatives."""
    b = run_full(spark, d).where("rank <= 11").select("query_id", "doc_id", "rank")
    p = b.where("rank = 1").select("query_id", F.col("doc_id").alias("positive"))
    return b.where("rank > 1").join(p, "query_id").select("query_id", "positive", F.col("doc_id").alias("negative"))
