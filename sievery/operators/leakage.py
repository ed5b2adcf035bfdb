"""Leakage between sets: ids, texts, digests and near-equal hashes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The keys that occur on both sides, once each."""
    return left.select(key).intersect(right.select(key))


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises with up to five examples if the sides share a key."""
    found = [r[0] for r in overlaps(left, right, key).limit(5).collect()]
    if found:
        raise ValueError(f"{key} on both sides, for example {found}")


def require_subset(rows: DataFrame, allowed: DataFrame, key: str) -> None:
    found = [r[0] for r in rows.select(key).join(allowed.select(key), key, "left_anti").distinct().limit(5).collect()]
    if found:
        raise ValueError(f"{key} outside the allowed ones, for example {found}")


def digest(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def group_overlap(rows: DataFrame, group: str, key: str) -> DataFrame:
    """For each two groups with a common key, how many keys they share.

    Each key's distinct groups are collected (their number is the number of groups, not of rows) and paired within the row."""
    sets = rows.select(key, group).distinct().groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    one = sets.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.greatest(F.size("g") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return one.groupBy("a", "b").agg(F.count("*").alias("shared"))


def hamming_matches(left: DataFrame, right: DataFrame, most: int, bits: int = 64, blocks: int = 10) -> DataFrame:
    """left (id_a, hash_a) and right (id_b, hash_b): pairs whose hashes of `bits` bits differ in at most `most` bits.

    The bits are cut into blocks; such a pair agrees in blocks - most of them at least, so the hashes meet on each choice
    of so many blocks: for 6 of 60 bits 210 keys of 24 bits, by which hashes that aren't near hardly ever meet."""
    if not 0 <= most < blocks:
        raise ValueError("at most blocks - 1 bits may differ")
    edges = [i * bits // blocks for i in range(blocks + 1)]
    of = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(of, blocks - most)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in chosen])

    def keyed(rows: DataFrame, key: str, h: str) -> DataFrame:
        return rows.select(key, h, F.posexplode(F.transform(masks, lambda m: F.col(h).bitwiseAND(m))).alias("choice", "part"))

    apart = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    # Spark's estimate doesn't know that each row becomes as many as there are choices: left to itself, it broadcasts them
    met = keyed(left, "id_a", "hash_a").join(keyed(right, "id_b", "hash_b").hint("shuffle_hash"), ["choice", "part"])
    return met.where(apart <= most).select("id_a", "id_b", apart.alias("distance")).distinct()


def hamming_nearest(rows: DataFrame, query: Column, most: int, bits: int = 60) -> DataFrame:
    """rows (id, hash): id, distance, match for each row with another row that meets `query` within `most` bits.

    Distinct hashes meet, whatever number of rows has them; a row gets its least distance and, at that distance, the least
    query id, or the greatest if that is its own. No pair of a group of equal hashes is made, and nothing is broadcast.
    rows are read several times: they should be persisted."""
    hashes = rows.groupBy("hash").agg(F.min(F.when(query, F.col("id"))).alias("low"), F.max(F.when(query, F.col("id"))).alias("high"))
    heads, a = hashes.where("low IS NOT NULL"), hashes.select(F.col("hash").alias("id_a"), F.col("hash").alias("hash_a"))
    near = hamming_matches(a, heads.select(F.col("hash").alias("id_b"), F.col("hash").alias("hash_b")), most, bits)
    found = near.join(heads.hint("merge"), near["id_b"] == heads["hash"]).select(F.col("id_a").alias("hash"), "distance", "low", "high")
    # per hash and distance the two ends are enough to leave a row's own id out
    ends = found.groupBy("hash", "distance").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    each = rows.join(ends.hint("merge"), "hash").withColumn("match", F.when(F.col("low") != F.col("id"), F.col("low")).when(F.col("high") != F.col("id"), F.col("high"))).where("match IS NOT NULL")
    return each.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("m")).select("id", "m.distance", "m.match")


def containments(texts: DataFrame, phrases: DataFrame, width: int = 8) -> DataFrame:
    """texts (doc_id, text) and phrases (item_id, phrase): pairs in which the text's words hold the phrase's words in a row.

    The hash of a phrase's first `width` words (all of a shorter phrase's) is looked for among the hashes of a text's
    windows of as many words. Only (doc_id, hash) pairs of a text are exploded and joined; the texts of the hits alone
    are fetched, once each, and their words compared. Texts with a null or repeated id are compared with the phrases met under that id."""
    gap = "[ \t\n\r]+"
    p = phrases.select("item_id", F.filter(F.split(F.trim("phrase"), gap), lambda w: w != "").alias("pw")).where(F.size("pw") > 0)
    p = p.withColumn("n", F.least(F.size("pw"), F.lit(width))).withColumn("key", F.xxhash64("n", F.array_join(F.slice("pw", F.lit(1), F.col("n")), " ")))
    sizes = sorted(r[0] for r in p.select("n").distinct().collect())  # at most `width` numbers
    words = F.filter(F.split("text", gap), lambda w: w != "")
    if not sizes:
        return texts.select("doc_id").crossJoin(phrases.select("item_id")).where("false")

    def keys(w: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i, F.lit(n)), " ")))
        return F.array_distinct(F.concat(*[of(n) for n in sizes]))

    held = F.transform(F.array(words), keys)[0]
    met = texts.select("doc_id", F.explode(held).alias("key")).join(p.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    whole = texts.select(F.col("doc_id").alias("_id"), spaced(words).alias("t"))
    hits = met.join(whole, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id").join(p.select("item_id", spaced(F.col("pw")).alias("q")), "item_id")
    return hits.where(F.contains("t", F.col("q"))).select("doc_id", "item_id").distinct()


def simhash(words: Column, bits: int = 60) -> Column:
    """A number whose bits are the majority of the bits of the distinct words' hashes: texts with nearly the same words differ in few bits; null without words.

    A word's hash is the start of its MD5, the same in any engine; the bits are summed in Arrow batches."""
    hashes = F.transform(F.array_distinct(words), lambda w: F.conv(F.substring(F.md5(w), 1, bits // 4), 16, 10).cast("long"))

    @F.pandas_udf("long")
    def majority(batch: pd.Series) -> pd.Series:
        # a plain map would turn the numbers into doubles where one of them is null
        return pd.Series(pd.array([major(h, bits) if h is not None and len(h) else None for h in batch], dtype="Int64"))

    return majority(hashes)


def major(hashes: np.ndarray, bits: int, step: int = 1 << 16) -> int:
    sums = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), step):
        part = np.asarray(hashes[at : at + step], np.int64)
        sums += (part[:, None] >> np.arange(bits) & 1).sum(axis=0)
    return int(((2 * sums > len(hashes)).astype(np.int64) << np.arange(bits)).sum())


def leaks(mined: DataFrame, held_out: DataFrame) -> DataFrame:
    """doc_id, by_id, by_text of the mined rows (doc_id, digest) whose id or text digest a held-out row has.

    Two equi-joins with the distinct ids and digests; a null id or digest leaks nothing."""
    ids = held_out.select(F.col("doc_id").alias("_id")).distinct()
    texts = held_out.select(F.col("digest").alias("_text")).distinct()
    both = mined.join(ids, mined["doc_id"] == ids["_id"], "left").join(texts, mined["digest"] == texts["_text"], "left")
    flags = both.groupBy("doc_id").agg(F.max(F.col("_id").isNotNull()).alias("by_id"), F.max(F.col("_text").isNotNull()).alias("by_text"))
    return flags.where("by_id OR by_text")


def require_clean(mined: DataFrame, held_out: DataFrame) -> None:
    """Raises with up to five examples if a mined row leaks."""
    found = [tuple(r) for r in leaks(mined, held_out).limit(5).collect()]
    if found:
        raise ValueError(f"mined queries leak, for example {found}")
