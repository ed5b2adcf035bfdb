"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles as 64-bit hashes. The hashes fall into buckets by their first bits;
a bucket's register keeps the least hash's count of leading zeros and the mantissa bits that follow. Documents with
equal sets form a class. Classes that share a band of registers are candidates, the collision-corrected estimate of
their Jaccard similarity, from finer registers, drops those far from the threshold, and the full sets of the others are compared.

All candidates of a large group are never emitted. Each class is first compared with a few hubs of its
buckets, which joins most of a group of near copies in a linear number of comparisons; after that, only pairs from
different components of a bucket are estimated, inside the tasks, and those near the threshold are emitted, the most
similar first, so that components grow together before the less similar pairs come up. The classes of a crowded
bucket, as of texts that share a long passage, meet in finer buckets instead: of all classes in crowded buckets, two
that are similar enough must share one of the rarest quarter of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, slices, written
from .hashing import ODD, mixed, runs

BUCKETS, MANTISSA, BAND = 128, 10, 4
#: Classes that meet in one task; a bucket of more is crowded.
CROWD = 400
#: Marks for the estimate: a byte for each of so many finer buckets.
MARKS = 512
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_ODD = np.uint64(ODD)
_TAKES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64) | np.uint64(1)
#: For an empty bucket, the order in which other buckets lend it their register.
_LENDERS = np.random.default_rng(7).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` lower-cased words; of fewer words, the whole sequence's."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    starts, _, word = runs(np.frombuffer(b" ".join(parts), np.uint8), _GAP)
    n = len(word) - width + 1
    whole = mixed(sum((word[k : k + n] * _TAKES[k] for k in range(width)), np.zeros(max(n, 0), np.uint64))) if n > 0 else word[:0]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        elif b > a:  # marked by how many words there are
            sets.append(mixed(np.array([(word[a:b] * _TAKES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(word[:0])
    return sets


def compressed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of a sorted, non-empty set: the least hash's leading zeros and mantissa bits in 16 bits, and whether the bucket has a hash."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    at = np.searchsorted(hashes, np.arange(buckets, dtype=np.uint64) << bits)
    full = at < np.append(at[1:], len(hashes))
    least = hashes[np.minimum(at, len(hashes) - 1)] & ((np.uint64(1) << bits) - np.uint64(1))
    # leading zeros among the bits that are left; one bit is set below them all, so there is a leading one
    least = np.maximum(least, np.uint64(1) << np.uint64(MANTISSA))
    length = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    length -= (least >> (length - np.uint64(1))) == 0  # rounded up to a power of two
    mantissa = (least >> (length - np.uint64(1 + MANTISSA))) & np.uint64((1 << MANTISSA) - 1)
    return (((bits - length) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16), full


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers for the bands. An empty bucket takes the register of the first non-empty bucket in its own random
    order, so that registers of small sets, too, are equal as often as the sets are similar."""
    out, full = compressed(hashes, BUCKETS)
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[_LENDERS[empty, full[_LENDERS[empty]].argmax(axis=1)]]
    return out


def marks(hashes: np.ndarray) -> np.ndarray:
    """The registers of finer buckets folded into 1 to 255, and 0 for an empty one."""
    out, full = compressed(hashes, MARKS)
    return np.where(full, 1 + (out.astype(np.uint64) * _ODD >> np.uint64(40)) % np.uint64(255), 0).astype(np.uint8)


def similar(equal: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may have a similarity of `percent` %: their sizes allow it, and the estimate is at most 4 standard errors below.

    equal: how many marks are equal, empty ones too; used: how many are not empty, in each and in both. The union's
    members that lie in one of the `used` buckets are a sample without replacement; unrelated members' marks are
    equal by chance once in 255 times, and so much is taken off."""
    used = used_a + used_b - both
    by_chance, level = 1 / 255, percent / 100
    estimate = ((equal - (MARKS - used)) / used - by_chance) / (1 - by_chance)
    union = np.maximum((size_a + size_b) / (1 + level), used)
    error = np.sqrt(level * (1 - level) / used * (union - used + 1) / union)
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (estimate >= level - 4 * error - 1 / used)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash (16 bytes, null if there is no shingle), text_hash, registers, marks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                yield pa.record_batch(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), part.column(2), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([marks(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n_shingles", "set_hash", "text_hash", "registers", "marks"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return mapped(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, set_hash binary, text_hash long, registers binary, marks binary")


def small_enough(table: DataFrame, row_bytes: int, most: int = 48 << 20) -> DataFrame:
    """A stored table with a broadcast hint if its rows take at most `most` bytes; otherwise the join shuffles."""
    return F.broadcast(table) if table.count() * row_bytes <= most else table


def full_sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node, members (bytes of the sorted hashes) for the given stored (node, text_hash, set_hash)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist())]
                right = [hashlib.blake2b(d, digest_size=16).digest() == h for d, h in zip(data, part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=["node", "members"]).filter(pa.array(right, pa.bool_()))

    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = texts.join(small_enough(nodes, 64), "text_hash").select("node", "text", "set_hash")
    return mapped(found, each, "node long, members binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of_a = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    of_b = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    few = small_enough(pairs, 16)  # so that sets which no pair needs aren't shuffled
    of_a = of_a.join(few.select("a"), "a", "left_semi")
    return mapped(few.join(of_b, "b").join(of_a, "a").select("a", "b", "x", "y"), each, "a long, b long")


def starred(edges: DataFrame, most: int = 1 << 19) -> DataFrame:
    """Edges (a, b) with the same components: those of each `most` or so that a task reads, as (least node, other node)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(h.shape[1] for h in held) >= most:
                yield contracted(np.concatenate(held, axis=1))
                held = []
        if held:
            yield contracted(np.concatenate(held, axis=1))

    def contracted(pairs: np.ndarray) -> pa.RecordBatch:
        node, place = np.unique(pairs, return_inverse=True)
        x, y = place.reshape(pairs.shape)
        label, last = np.arange(len(node)), None
        while last is None or (label != last).any():
            last, low = label, np.minimum(label[x], label[y])
            label = last.copy()
            np.minimum.at(label, last[x], low)
            np.minimum.at(label, last[y], low)
            label = label[label]
        other = np.flatnonzero(label != np.arange(len(node)))
        return pa.record_batch([pa.array(node[label[other]]), pa.array(node[other])], names=["a", "b"])

    return mapped(edges.select("a", "b"), each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the stored edges (a, b), none from a node to itself: comp is the least node reachable.

    Tasks first contract the edges they read. Each round then takes the least label among neighbours and the label of
    that label, into a stored table, until none changes."""
    links = written(starred(edges), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumn("moved", F.lit(True)), "labels")
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        new = labels.select("node", F.col("comp").alias("old")).join(near, "node").withColumn("low", F.least("low", "old"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = new.join(jump, "low").select("node", F.least("low", "far").alias("comp"), "old")
        labels = written(new.select("node", "comp", (F.col("comp") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "comp")


def across(rows: DataFrame, percent: int, first: int, end: int, block: int = CROWD) -> DataFrame:
    """Pairs (a, b) of rows (key, band, bands, node, comp, n, marks, registers) with one key and different comp that may be similar and whose place is in [first, end).

    A key with more than `block` rows is dealt into blocks, and each two blocks meet in a task of their own. A pair's
    place is its rank by similarity among all pairs of the one or the other there, whichever is less: it doesn't
    depend on comp or on the order in which rows arrive, so ranges of places that cover everything find every pair, the most promising ones first. A pair
    that shares several keys comes from the first band alone, among the bits of `bands`, in which its registers are equal.
    Of finer buckets, which are no bands, `registers` are the slots and `bands` those that hold a lesser bucket: a pair
    comes from its least bucket, and from others only where slots hide that one."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / block))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    spread = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").select("key", "lo", "hi", "node", "comp", "n", "marks", "mine", "band", "bands", "registers")

    def met(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group).combine_chunks()
        node, comp, n, mine = (t.column(c).to_numpy() for c in ("node", "comp", "n", "mine"))
        mark = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, MARKS)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        found = pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
        if len(left) and len(right) and comp.min() < comp.max():
            used = (mark > 0).astype(np.float32)
            others, full = mark[right], used.sum(axis=1).astype(np.int64)
            equal = np.stack([np.count_nonzero(others == mark[i], axis=1) for i in left])
            both = (used[left] @ used[right].T).astype(np.int64)
            may = similar(equal, full[left][:, None], full[right][None, :], both, n[left][:, None], n[right][None, :], percent) & (node[left][:, None] != node[right][None, :])
            worth = np.where(may, equal, -1)
            place = np.minimum(np.argsort(np.argsort(-worth, axis=1, kind="stable"), axis=1), np.argsort(np.argsort(-worth, axis=0, kind="stable"), axis=0))
            i, j = np.nonzero(may & (place >= first) & (place < end) & (comp[left][:, None] != comp[right][None, :]))
            lower = t.column("band")[0].as_py()
            bands = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint64).reshape(len(node), -1)[:, :lower]
            counts = (t.column("bands").to_numpy()[:, None] >> np.arange(lower) & 1).astype(bool)
            once = np.concatenate([np.zeros(0, bool), *[~((bands[left[i[k : k + 10_000]]] == bands[right[j[k : k + 10_000]]]) & counts[left[i[k : k + 10_000]]]).any(axis=1) for k in range(0, len(i), 10_000)]])
            a, b = node[left[i[once]]], node[right[j[once]]]
            found = pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        return found

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and any(held[0].column(c)[0] != batch.column(c)[a] for c in range(3)):
                    yield met(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield met(held)

    return mapped(spread, each, "a long, b long").distinct()


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(node, key): the finer buckets of (node, members), one for each of a set's rarest shingles that another set has as well.

    With all shingles in one order, by how many of the sets have them, two sets of n and m members that are similar
    to `percent` % share one of the first n - ceil(n * percent / 100) + 1 of the one and as many of the other: no pair is
    lost. A passage's shingles come last in the order and so are no buckets, unless they are most of a set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column(0), batch.column(1), strict=True):
                key = np.frombuffer(data.as_buffer(), np.int64)
                for k in range(0, len(key), 100_000):
                    some = key[k : k + 100_000]
                    yield pa.record_batch([pa.array(np.full(len(some), node.as_py())), pa.array(some), pa.array(np.full(len(some), len(key)))], names=["node", "key", "n"])

    rows = written(mapped(sets.select("node", "members"), each, "node long, key long, n long"), "shingles")
    common = rows.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    held = rows.join(common, "key").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("keys"))
    # those that no other set has come first in the order: they take up places, but are no buckets
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("keys"))
    return held.select("node", F.explode(F.slice("keys", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))).alias("k")).select("node", "k.key")


def slotted(finer: DataFrame, slots: int = 64) -> DataFrame:
    """(node, slots, registers): the least of a node's finer buckets (node, key) among those of each remainder, 0 if none, and their bytes."""
    least = F.array(*[F.coalesce(F.min(F.when(F.pmod("key", F.lit(slots)) == s, F.col("key"))), F.lit(0)) for s in range(slots)])
    return finer.groupBy("node").agg(least.alias("slots")).withColumn("registers", F.unhex(F.array_join(F.transform("slots", lambda k: F.lpad(F.hex(k), 16, "0")), "")))


def below(slots: Column, key: Column) -> Column:
    """A bit for each slot that holds a lesser bucket than key. A pair that has such a slot in common meets there as well."""
    bits = F.transform(slots, lambda k, i: F.when((k != 0) & (k < key), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def near_duplicates(docs: DataFrame, percent: int = 75, stars: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| of their sets of five-word shingles; component_id is
    the least id reachable, kept whether that is the row's own. A null text, or one without words, has no shingle, is
    linked with nothing and keeps its id as component_id. Equal texts are linked, also under one id; a null id is
    never a component_id unless no other is reachable. So all rows of the least id are marked as kept, and all rows of
    a group that has null ids only; deduplicated() keeps one of them. Columns other than the two named are not read. An
    empty table gives an empty result. Candidate pairs and moved
    components are broadcast if, counted, they take at most 48 MB, and shuffled otherwise: the rows are the same. With
    32 bands of 4 registers a pair at the threshold is missed with a chance of 5e-6."""
    component = F.coalesce("component_id", "id")
    out = linked_rows(docs, percent, stars, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def linked_rows(docs: DataFrame, percent: int, stars: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, text_hash of each row, and of rows in groups of two or more comp (a number for the group) and component_id."""
    sketch = written(sketched(docs, id_col, text_col), "sketch")
    classes = sketch.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("marks").alias("marks"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def band(i: Column) -> Column:
        return F.xxhash64(i, F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND)))

    bands = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // BAND - 1)), band)).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    met = written(bands.join(shared, "key"), "bands")

    marks_of = classes.select("node", "marks", "n")
    wanted = written(met.select("node").distinct().join(classes.select("node", "text_hash", "set_hash"), "node"), "wanted")
    sets = written(full_sets(docs, wanted, text_col), "sets")

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, MARKS) for c in (2, 3))
                keep = similar((x == y).sum(axis=1), (x > 0).sum(axis=1), (y > 0).sum(axis=1), ((x > 0) & (y > 0)).sum(axis=1), part.column(4).to_numpy(), part.column(5).to_numpy(), percent)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def pair_up(pairs: DataFrame) -> DataFrame:
        of_a = marks_of.select(F.col("node").alias("a"), F.col("marks").alias("x"), F.col("n").alias("n_a"))
        of_b = marks_of.select(F.col("node").alias("b"), F.col("marks").alias("y"), F.col("n").alias("n_b"))
        few = small_enough(written(pairs, "hubs"), 16)
        both = few.join(of_b, "b").join(of_a.join(few.select("a"), "a", "left_semi"), "a").select("a", "b", "x", "y", "n_a", "n_b")
        return mapped(both, estimated, "a long, b long")

    def with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        return rows.withColumn("comp", F.col("node")) if comps is None else rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    comps = None

    def stars_over(met: DataFrame, rounds: range) -> None:
        """Each class that shares a bucket with another component is compared with one random hub of its buckets for each of `rounds`."""
        seen = with_comp(met, comps)
        hub = {r: F.min(F.struct(F.xxhash64("node", F.lit(r)), F.col("node"), F.col("comp"))).alias(f"hub{r}") for r in rounds}
        hubs = seen.groupBy("key").agg(*hub.values(), F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").drop("l", "h")
        nearest = [F.min(F.when(F.col("comp") != F.col(f"hub{r}.comp"), F.struct(F.xxhash64("node", f"hub{r}.node", F.lit(r)), F.col(f"hub{r}.node").alias("node"))))["node"] for r in rounds]
        chosen = seen.join(hubs, "key").groupBy("node").agg(F.array_distinct(F.array_compact(F.array(*nearest))).alias("hubs"))
        pairs = written(pair_up(chosen.select(F.explode("hubs").alias("a"), F.col("node").alias("b"))), "stars")
        grow(confirmed(pairs, sets, percent))

    def grow(found: DataFrame) -> None:
        """Adds links to the components: those of the components that the links join, and of nodes that had none."""
        nonlocal comps
        found = written(found, "edges")
        if found.isEmpty():
            return
        if comps is None:
            comps = components(found)
            return
        ends = with_comp(found.select("b", F.col("a").alias("node")), comps).select(F.col("comp").alias("a"), F.col("b").alias("node"))
        joined = components(written(with_comp(ends, comps).select("a", F.col("comp").alias("b")).where("a != b").distinct(), "joins"))
        alone = found.select(F.explode(F.array("a", "b")).alias("node")).withColumn("comp", F.col("node"))
        known = comps.unionByName(alone).groupBy("node").agg(F.min("comp").alias("was"))
        moved = small_enough(joined.select(F.col("node").alias("was"), F.col("comp").alias("now")), 32)
        comps = written(known.join(moved, "was", "left").select("node", F.coalesce("now", "was").alias("comp")), "comps")

    def pairs_over(met: DataFrame, sketch_of: DataFrame) -> None:
        """What shares a bucket but not a component yet, the most similar first."""
        for first, end in ((0, 2), (2, 1 << 62)):
            seen = with_comp(met, comps)
            mixed_keys = seen.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").select("key")
            others = written(across(seen.join(mixed_keys, "key").join(sketch_of, "node"), percent, first, end), "others")
            if not others.isEmpty():
                grow(confirmed(others, sets, percent))

    stars_over(met, range(stars))
    left = with_comp(met, comps)
    mixed_keys = written(left.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h"), F.count("*").alias("c")).where("l < h").select("key", (F.col("c") > CROWD).alias("crowded")), "mixed")
    few = met.join(mixed_keys.where("NOT crowded").select("key"), "key")
    used = few.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands"))
    pairs_over(written(few.join(used, "node"), "few"), classes.select("node", "marks", "n", "registers"))
    if not mixed_keys.where("crowded").isEmpty():
        crowd = written(met.join(mixed_keys.where("crowded").select("key"), "key").select("node").distinct(), "crowd")
        finer = written(rarest(sets.join(crowd, "node"), percent), "finer")
        stars_over(finer, range(stars, stars + 1))
        slots = written(slotted(finer), "slots")
        lesser = finer.join(slots, "node").select("node", "key", F.lit(64).alias("band"), below(F.col("slots"), F.col("key")).alias("bands"))
        pairs_over(lesser, marks_of.join(slots.select("node", "registers"), "node"))
    linked = with_comp(classes.select("node", "set_hash", "rep", "rows"), comps)
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("size")).where("size > 1").select("comp", "component_id")
    of_set = linked.join(least, "comp").select("set_hash", "comp", "component_id")
    return sketch.select("id", "n_shingles", "text_hash", "set_hash").join(of_set, "set_hash", "left").drop("set_hash")


def deduplicated(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near_duplicates(), with all its columns: of the least id (null last), then of the least text hash.

    Rows without a shingle are in no component and stay. Of rows with one id (also null) and equal texts, one stays.
    It is decided by id and text: an id's other texts stay if they are the first of their own component."""
    found = written(linked_rows(docs, percent, 3, id_col, text_col), "near")
    grouped = found.where("comp IS NOT NULL")
    first = grouped.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))).alias("first"))
    others = grouped.select("comp", "id", "text_hash").distinct().join(first, "comp").where("NOT (id <=> first.id AND text_hash = first.text_hash)")
    gone = written(others.select(F.col("id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct(), "gone")
    mark = "_hash" + "_" * max([0, *(len(c) for c in docs.columns)])  # no column of docs
    hashed = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))

    def same(other: DataFrame) -> Column:
        return hashed[id_col].eqNullSafe(other["_gone_id"]) & (hashed[mark] == other["_gone_hash"])

    left = hashed.join(small_enough(gone, 32), same(gone), "left_anti")
    again = written(found.groupBy(F.col("id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return left.drop(mark)
    repeated = left.join(again, same(again), "left_semi").dropDuplicates([id_col, mark])
    return left.join(again, same(again), "left_anti").unionByName(repeated).drop(mark)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
