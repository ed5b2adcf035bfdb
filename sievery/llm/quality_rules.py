"""Quality rules in DataFrame operations only: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. A multinomial over the buckets is estimated from trusted texts and one
from the raw corpus; a document's mean log ratio of the two, over its n-grams, is compared with a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, labels, let, sampled

BUCKETS = 8192
#: Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.05


def all_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def hashed(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the words and of the pairs of neighbouring words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
    return F.concat(one, two)


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text has more than once; words is a column, not an expression."""
    n = F.size(words)
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        """Of the windows sorted with their places, the places of those equal to a neighbour."""
        return F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull())

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        words_of = F.flatten(F.transform(let(ordered, places), lambda p: F.array(p, p + 1, p + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(words_of)))

    return F.coalesce(let(windows, covered), F.lit(0)).cast("long")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words (array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has no words and fails."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = docs.withColumn("_words", all_words(text)).withColumn("_lines", lines)
    found = found.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    })
    return found.drop("_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> list[float]:
    """log p(bucket | trusted) - log p(bucket | raw) of every bucket; the trusted counts are smoothed by `buckets` draws from the raw distribution.

    The raw counts cover all of docs; trusted (distinct doc_id) must be bounded, as it is broadcast. One pass whose
    partial sums hold `buckets` rows for each task; `buckets` rows come to the driver."""
    flagged = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "doc_id", "left")
    grams = flagged.select("trusted", F.explode(hashed(all_words(F.col("text")), buckets)).alias("b"))
    counts = {r["b"]: (r["good"], r["raw"]) for r in grams.groupBy("b").agg(F.count("trusted").alias("good"), F.count("*").alias("raw")).collect()}
    good, raw = (sum(c[k] for c in counts.values()) for k in (0, 1))
    ratios = []
    for g, r in (counts.get(b, (0, 0)) for b in range(buckets)):
        q = (r + 1) / (raw + buckets)
        ratios.append(math.log((g + buckets * q) / (good + buckets)) - math.log(q))
    return ratios


def judged(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """base_rules() with llr (mean log ratio of the document's n-grams; 0 where it has none) and kept."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one constant
    grams = hashed(F.col("_words"), len(ratios))
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int")))
    mean = total / F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    found = base_rules(docs).withColumn("llr", F.coalesce(mean, F.lit(0.0)))
    return found.drop("_words").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_ids(labelled: DataFrame, most: int = 8192) -> DataFrame:
    """At most `most` ids of documents labelled as good, by hash bins of the id; null ids are left out."""
    good = labelled.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("one"))
    return sampled(good, "one", most).select("doc_id").distinct()


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents by the rules; trained on at most 8,192 trusted documents, raw counts over all.

    Null texts count as empty and fail; null and repeated ids are judged row by row; an empty table gives an empty result."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ratios = log_ratios(docs, trusted_ids(labels(spark, sf_dir)))
    return judged(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
