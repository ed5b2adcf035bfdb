"""Evaluation over several benchmarks: categories as queries, selection signals, averages, gates, gap lists; checks of mined queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievery.functions.text import hashed_unit
from sievery.functions.vectors import unit
from sievery.operators import leakage, retrieval

from .base import RUNS_SQL, query, run_full, run_prefix, table, vectors


def ap10(found: str = "n_rel"):
    """Average precision at 10 of a query's ranked rows (grouped), divided by the smaller of 10 and its relevant rows."""
    hits = F.array_sort(F.collect_list(F.when((F.col("grade") > 0) & (F.col("rank") <= 10), F.col("rank"))))  # ten numbers at most
    total = F.aggregate(F.transform(hits, lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total / F.least(F.lit(10), F.first(found)), F.lit(0.0))


@query(
    "category_to_product",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e),
    c0 AS (SELECT label, i, avg(u[i]) AS x FROM u, range(1, 65) t(i) WHERE vec_id % 2 = 0 GROUP BY label, i), c1 AS (SELECT label, list(x ORDER BY i) AS m FROM c0 GROUP BY label),
    c AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS q FROM c1 WHERE label IN (SELECT label FROM u WHERE vec_id % 2 = 1 GROUP BY label HAVING count(*) >= 2)),
    r AS (SELECT c.label AS query_id, vec_id AS doc_id, (u.label = c.label)::INT AS grade, row_number() OVER (PARTITION BY c.label ORDER BY round(list_inner_product(q, u), 6) DESC, vec_id) AS rank FROM c, u WHERE vec_id % 2 = 1 QUALIFY rank <= 10),
    s AS (SELECT label AS query_id, count(*) AS n_rel FROM u WHERE vec_id % 2 = 1 GROUP BY label),
    h AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r)
    SELECT query_id, round(sum(grade * k / rank) / least(10, any_value(n_rel)), 6) AS ap10, round(coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0), 6) AS mrr, round(sum(grade) / 10.0, 6) AS precision_10
    FROM h JOIN s USING (query_id) GROUP BY query_id""",
)
def category_to_product(spark, d):
    """Categories with two items or more as queries: the mean direction of half of the items looks for the other half. A row a category is all that is searched for."""
    g = vectors(spark, d)
    items = g.where("doc_id % 2 = 1")
    sizes = items.groupBy("label").agg(F.count("*").alias("n_rel")).where("n_rel >= 2")
    means = g.where("doc_id % 2 = 0").select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    queries = whole.join(sizes, "label", "left_semi").select(F.col("label").cast("long").alias("query_id"), unit(F.col("m")).alias("vector"))
    run = retrieval.knn(queries, items, 10, skip_self=False).join(items.select("doc_id", "label"), "doc_id").withColumn("grade", (F.col("label") == F.col("query_id")).cast("int"))
    graded = run.join(sizes.select(F.col("label").cast("long").alias("query_id"), "n_rel"), "query_id")
    first = F.min(F.when(F.col("grade") > 0, F.col("rank")))
    out = graded.groupBy("query_id").agg(F.round(ap10(), 6).alias("ap10"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("mrr"), F.round(F.sum("grade") / 10.0, 6).alias("precision_10"))
    return out.withColumn("query_id", F.col("query_id").cast("int"))


MODELS_SQL = RUNS_SQL + ", r AS (SELECT 'full' AS model, * FROM run_a UNION ALL SELECT 'prefix', * FROM run_b), q AS (SELECT vec_id AS query_id, label AS benchmark FROM e WHERE vec_id % 50 = 0)"


def models(spark, d):
    """The rows of two models' runs and the queries of all benchmarks (labels), also those that a run lacks."""
    runs = run_full(spark, d).withColumn("model", F.lit("full")).unionByName(run_prefix(spark, d).withColumn("model", F.lit("prefix")))
    queries = vectors(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("benchmark"))
    return runs, queries


def reciprocal(runs, queries, k: int = 10):
    """model, benchmark, mrr over the first k rows: divided by the queries of the truth, whether the run has them or not."""
    sizes = queries.groupBy("benchmark").agg(F.count("*").alias("n_queries"))
    best = runs.where((F.col("rank") <= k) & (F.col("grade") > 0)).groupBy("model", "query_id").agg((1.0 / F.min("rank")).alias("rr"))
    named = F.array(F.lit("full"), F.lit("prefix"))
    every = sizes.withColumn("model", F.explode(named))
    sums = best.join(queries, "query_id").groupBy("model", "benchmark").agg(F.sum("rr").alias("rr"))
    return every.join(sums, ["model", "benchmark"], "left").select("model", "benchmark", (F.coalesce("rr", F.lit(0.0)) / F.col("n_queries")).alias("mrr"))


@query(
    "selection_signal",
    f"""WITH {MODELS_SQL}, n AS (SELECT benchmark, count(*) AS n FROM q GROUP BY benchmark), b AS (SELECT model, query_id, 1.0 / min(rank) AS rr FROM r WHERE rank <= 10 AND grade > 0 GROUP BY ALL),
    p AS (SELECT m.model, n.benchmark, coalesce((SELECT sum(rr) FROM b JOIN q USING (query_id) WHERE b.model = m.model AND q.benchmark = n.benchmark), 0) / n AS mrr FROM n, (VALUES ('full'), ('prefix')) m(model))
    SELECT model, count(*) AS benchmarks, round(avg(mrr), 6) AS signal, (row_number() OVER (ORDER BY round(avg(mrr), 6) DESC, model) = 1) AS selected FROM p GROUP BY model""",
)
def selection_signal(spark, d):
    """MRR at 10 averaged over benchmarks, each counting alike, and the model that it selects; of equal ones the first by name."""
    per = reciprocal(*models(spark, d)).groupBy("model").agg(F.count("*").alias("benchmarks"), F.round(F.avg("mrr"), 6).alias("signal"))
    order = Window.orderBy(F.desc("signal"), "model")  # a row a model
    return per.withColumn("selected", F.row_number().over(order) == 1)


@query(
    "benchmark_averages",
    f"""WITH {MODELS_SQL}, x AS (SELECT model, benchmark, query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p10, max(CASE WHEN rank <= 1 THEN grade ELSE 0 END) AS hit1 FROM r JOIN q USING (query_id) GROUP BY ALL),
    m AS (SELECT model, benchmark, 'precision_10' AS metric, avg(p10) AS v FROM x GROUP BY ALL UNION ALL SELECT model, benchmark, 'hit_1', avg(hit1) FROM x GROUP BY ALL)
    SELECT model, metric, count(*) AS benchmarks, round(avg(v), 6) AS mean, round(min(v), 6) AS worst, round(max(v), 6) AS best FROM m GROUP BY model, metric""",
)
def benchmark_averages(spark, d):
    """For each model and metric the mean, worst and best over benchmarks of the benchmarks' own means."""
    runs, queries = models(spark, d)
    x = runs.join(queries, "query_id").groupBy("model", "benchmark", "query_id").agg((F.sum(F.when(F.col("rank") <= 10, F.col("grade")).otherwise(0)) / 10.0).alias("precision_10"), F.max(F.when(F.col("rank") <= 1, F.col("grade")).otherwise(0)).cast("double").alias("hit_1"))
    m = x.groupBy("model", "benchmark").agg(F.avg("precision_10").alias("precision_10"), F.avg("hit_1").alias("hit_1")).unpivot(["model", "benchmark"], ["precision_10", "hit_1"], "metric", "v")
    return m.groupBy("model", "metric").agg(F.count("*").alias("benchmarks"), *[F.round(f("v"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "worst"), (F.max, "best"))])


@query(
    "gap_and_win_lists",
    f"""WITH {MODELS_SQL}, h AS (SELECT *, sum(grade) OVER (PARTITION BY model, query_id ORDER BY rank) AS k FROM r WHERE rank <= 10),
    a AS (SELECT model, query_id, sum(grade * k / rank) / least(10, any_value(n_rel)) AS ap FROM h JOIN rel USING (query_id) GROUP BY ALL),
    j AS (SELECT f.query_id, round(f.ap, 6) AS ap_full, round(p.ap, 6) AS ap_prefix, round(f.ap - p.ap, 6) AS delta FROM a f JOIN a p USING (query_id) WHERE f.model = 'full' AND p.model = 'prefix'),
    l AS (SELECT 'target' AS list, *, row_number() OVER (ORDER BY ap_prefix, query_id) AS nth FROM j WHERE ap_prefix < 0.3
      UNION ALL SELECT 'gap', *, row_number() OVER (ORDER BY delta DESC, query_id) FROM j WHERE delta > 0 UNION ALL SELECT 'win', *, row_number() OVER (ORDER BY delta, query_id) FROM j WHERE delta < 0)
    SELECT * FROM l WHERE nth <= 20""",
)
def gap_and_win_lists(spark, d):
    """Twenty queries each: the prefix model's lowest average precisions below 0.3, where it is furthest behind, and where it is furthest ahead."""
    runs, _ = models(spark, d)
    g = vectors(spark, d)
    sizes = g.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    rel = g.where("doc_id % 50 = 0").join(sizes, "label").select(F.col("doc_id").alias("query_id"), "n_rel")
    ap = runs.where("rank <= 10").join(rel, "query_id").groupBy("model", "query_id").agg(ap10().alias("ap"))
    of = lambda m: ap.where(F.col("model") == m).select("query_id", F.col("ap").alias(f"ap_{m}"))
    j = of("full").join(of("prefix"), "query_id").select("query_id", F.round("ap_full", 6).alias("ap_full"), F.round("ap_prefix", 6).alias("ap_prefix"), F.round(F.col("ap_full") - F.col("ap_prefix"), 6).alias("delta"))
    lists = [("target", F.col("ap_prefix") < 0.3, F.col("ap_prefix")), ("gap", F.col("delta") > 0, F.desc("delta")), ("win", F.col("delta") < 0, F.col("delta"))]
    out = None
    for name, some, order in lists:
        top = j.where(some).orderBy(order, "query_id").limit(20)  # a report of twenty rows
        part = top.withColumn("list", F.lit(name)).withColumn("nth", F.row_number().over(Window.partitionBy("list").orderBy(order, "query_id")))
        out = part if out is None else out.unionByName(part)
    return out


ALPHAS = (0.2, 0.5, 0.8)


@query(
    "eligibility_gate",
    f"""WITH {MODELS_SQL}, j AS (SELECT query_id, doc_id, a.score AS sa, b.score AS sb, a.grade FROM run_a a JOIN run_b b USING (query_id, doc_id)), w AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS alpha),
    f AS (SELECT alpha, query_id, grade, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(alpha * sa + (1 - alpha) * sb, 6) DESC, doc_id) AS rank FROM j, w),
    c AS (SELECT alpha, benchmark, avg(p) AS p FROM (SELECT alpha, query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM f GROUP BY ALL) JOIN q USING (query_id) GROUP BY ALL),
    o AS (SELECT benchmark, avg(p) AS base FROM (SELECT query_id, sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END) / 10.0 AS p FROM run_b GROUP BY 1) JOIN q USING (query_id) GROUP BY ALL),
    s AS (SELECT alpha, round(min(p - base), 6) AS worst, round(avg(CASE WHEN base > 0 THEN (p - base) / base ELSE 0 END), 6) AS gain FROM c JOIN o USING (benchmark) GROUP BY alpha)
    SELECT alpha, worst, gain, (worst >= 0 AND gain > 0) AS eligible, row_number() OVER (ORDER BY worst DESC, gain DESC, alpha) AS place FROM s""",
)
def eligibility_gate(spark, d):
    """Weights of a fusion: eligible if no benchmark loses precision against the prefix model and the mean relative gain is above 0; in order of the worst, then the mean gain."""
    runs, queries = models(spark, d)
    a = runs.where("model = 'full'").select("query_id", "doc_id", F.col("score").alias("sa"), "grade")
    b = runs.where("model = 'prefix'").select("query_id", "doc_id", F.col("score").alias("sb"))
    fused = a.join(b, ["query_id", "doc_id"]).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS)))).withColumn("s", F.round(F.col("alpha") * F.col("sa") + (1 - F.col("alpha")) * F.col("sb"), 6))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc("s"), "doc_id")))
    p10 = F.sum(F.when(F.col("rank") <= 10, F.col("grade")).otherwise(0)) / 10.0
    mine = ranked.groupBy("alpha", "query_id").agg(p10.alias("p")).join(queries, "query_id").groupBy("alpha", "benchmark").agg(F.avg("p").alias("p"))
    base = runs.where("model = 'prefix'").groupBy("query_id").agg(p10.alias("p")).join(queries, "query_id").groupBy("benchmark").agg(F.avg("p").alias("base"))
    gain = F.when(F.col("base") > 0, (F.col("p") - F.col("base")) / F.col("base")).otherwise(0.0)
    s = mine.join(base, "benchmark").groupBy("alpha").agg(F.round(F.min(F.col("p") - F.col("base")), 6).alias("worst"), F.round(F.avg(gain), 6).alias("gain"))
    place = F.row_number().over(Window.orderBy(F.desc("worst"), F.desc("gain"), "alpha"))  # a row a weight
    return s.select("alpha", "worst", "gain", ((F.col("worst") >= 0) & (F.col("gain") > 0)).alias("eligible"), place.alias("place"))


def splits(spark, d):
    """Documents dealt to splits by id, so that texts which occur twice may be in several."""
    u = hashed_unit("31", F.col("doc_id"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return docs.withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test"))


SPLITS_SQL = """u AS (SELECT doc_id, text, ('0x' || substr(md5('31|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, md5(lower(trim(text))) AS t, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u)"""


@query("forbidden_texts", f"WITH {SPLITS_SQL} SELECT t AS digest, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split <> 'train') AS n_held_out FROM s GROUP BY t HAVING n_train > 0 AND n_held_out > 0")
def forbidden_texts(spark, d):
    """Texts that must not be trained on: in train and also in validation or test. Digests are shuffled, not texts."""
    s = splits(spark, d).select("split", leakage.digest(F.col("text")).alias("digest"))
    train = F.col("split") == "train"
    return s.groupBy("digest").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_held_out")).where("n_train > 0 AND n_held_out > 0")


@query(
    "mined_query_leaks",
    f"""WITH {SPLITS_SQL}, m AS (SELECT doc_id, t FROM s WHERE split = 'train' AND doc_id % 3 = 0 UNION ALL SELECT doc_id, t FROM s WHERE split = 'test' AND doc_id % 10 = 0)
    SELECT m.doc_id, bool_or(e.doc_id = m.doc_id) AS by_id, bool_or(e.t = m.t) AS by_text FROM m JOIN s e ON e.split <> 'train' AND (e.doc_id = m.doc_id OR e.t = m.t) GROUP BY m.doc_id""",
)
def mined_query_leaks(spark, d):
    """Mined queries (some of train, and a few of test that slipped in) that have the id or the text of a held-out row."""
    s = splits(spark, d).select("doc_id", "split", leakage.digest(F.col("text")).alias("digest"))
    mined = s.where("(split = 'train' AND doc_id % 3 = 0) OR (split = 'test' AND doc_id % 10 = 0)").select("doc_id", "digest")
    return leakage.leaks(mined, s.where("split <> 'train'").select("doc_id", "digest"))
