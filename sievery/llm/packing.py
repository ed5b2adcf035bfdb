"""Packing token sequences by cutting-stock column generation.

Texts become token ids, cut into pieces of at most `capacity`. The histogram of the pieces' lengths (at most 256
bins, whatever the input's size) is a cutting-stock problem: its linear program over patterns is solved on the driver
by column generation, where a knapsack dynamic program prices new patterns. The patterns' rounded counts say, for
each bin, which ranks go to which sequences; the executors rank the pieces of each bin and look their sequence up.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mapped, resident, slices, written

ODD_SPACES = re.compile(r" \s|\s ")


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of byte-level BPE given as a file of ranks.

    special names strings that stand for one id wherever they occur. The pre-tokenizer's pattern never joins a single
    space between two other characters with what stands before it, so texts are encoded word by word and each word
    once; texts with other white space beside a space are encoded whole. keep bounds the bytes that remembered words
    take, about; words beyond 64 characters aren't remembered."""

    def __init__(self, rank_file: str, pattern: str, special: dict[str, int], keep: int = 32 << 20):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, rank in [*ranks.items(), *special.items()]:
            self.sizes[rank] = len(token.encode() if isinstance(token, str) else token)
        self.memo: dict[str, bytes] = {}
        self.keep = keep

    def encoded(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def learn(self, words: list[str]) -> None:
        """Remember the ids of each word after a space: all are encoded as one text, which is cut by the tokens' sizes."""
        texts = [" " + w for w in words]
        ids = self.encoded("".join(texts))
        ends = np.searchsorted(self.sizes[ids].cumsum(), np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)).cumsum()) + 1
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.memo[word] = data[at:end]
            at = end

    def many(self, texts: list[str | None]) -> list[bytes]:
        memo = self.memo
        if 240 * len(memo) > self.keep:  # a word of at most 64 characters, its ids and their places in the table
            memo.clear()
        heads, split = [], []
        for text in texts:
            if not text or ODD_SPACES.search(text) or text[0] == " " or text[-1] == " ":
                head, rest = text or "", []
            else:
                head, *rest = text.split(" ")
            heads.append(self.encoded(head).tobytes() if head else b"")
            split.append(rest)
        unseen = list(set().union(*split).difference(memo))
        for i in range(0, len(unseen), 20_000):
            self.learn(unseen[i : i + 20_000])
        found = [head + b"".join(map(memo.__getitem__, rest)) for head, rest in zip(heads, split, strict=True)]
        for word in unseen:
            if len(word) > 64:
                del memo[word]
        return found


def token_pieces(docs: DataFrame, rank_file: str, pattern: str, special: dict[str, int], end_id: int = 0, capacity: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row's ids and end_id, in order: full ones of `capacity`, then the rest.

    Columns: id, start, length, ids_crc32, doc_tokens, ids (binary, null unless keep_ids), and part and nth: the
    task that made the piece and how many pieces of its length that task made before it. A null text counts as
    empty: one piece that holds end_id alone. Repeated rows are packed each for itself."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("ids", rank_file, pattern, tuple(special.items())), lambda: Encoder(rank_file, pattern, special))
        context, made = TaskContext.get(), Counter()
        part = context.partitionId() if context else 0
        for batch in batches:
            for some in slices(batch, 1):
                row, columns = [], [[], [], [], [], [], []]
                for r, ids in enumerate(encoder.many(some.column(1).to_pylist())):
                    data = ids + end
                    for at in range(0, len(data), 4 * capacity):
                        piece = data[at : at + 4 * capacity]
                        length = len(piece) // 4
                        row.append(r)
                        for column, value in zip(columns, (at // 4, length, zlib.crc32(piece), len(data) // 4, piece if keep_ids else None, made[length]), strict=True):
                            column.append(value)
                        made[length] += 1
                arrays = [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)]
                yield pa.record_batch([some.column(0).take(pa.array(row, pa.int64())), *arrays, pa.array([part] * len(row), pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids", "nth", "part"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows, each, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, nth long, part long").withColumnRenamed("id", id_col)


def priced(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: for each room from 0 to capacity the value of the best pattern, and which of the lengths (ascending) to take first (-1: leave one token free)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            worth = best[c - lengths[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], took[c] = worth[i], i
    return best, took


def best_pattern(took: np.ndarray, lengths: np.ndarray, capacity: int, first: int | None = None) -> np.ndarray:
    """The best pattern, as how many of each length; with `first`, the best of those that hold that length."""
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    if first is not None:
        pattern[first] += 1
        c -= lengths[first]
    while c > 0:
        i = took[c]
        if i < 0:
            c -= 1
        else:
            pattern[i] += 1
            c -= lengths[i]
    return pattern


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 1000, columns: int = 40) -> tuple[np.ndarray, np.ndarray, dict]:
    """The linear program min sum(x), sum of x times patterns >= counts: its basic patterns (a column each), x, and a report.

    It starts from the plain basis in which each pattern holds one length alone. Each round the knapsack program prices
    the columns, at prices halfway to those of the best bound so far; up to `columns` patterns of negative reduced cost,
    each the best one with some length, join the pool, from which the revised simplex method takes entering columns
    until none is left. A length may be held more often than needed, at no cost, which keeps prices from turning
    negative. It ends when no column has a negative reduced cost, or the objective is within `gap` of a lower bound:
    the tokens over the capacity, or the counts' worth at prices scaled so that no pattern is worth more than one."""
    m = len(lengths)
    each = capacity // lengths
    basis, inverse, x, cost = np.diag(each).astype(float), np.diag(1.0 / each), counts / each, np.ones(m)
    pool, held = np.zeros((0, m)), None
    bound, held_bound, done = (lengths * counts).sum() / capacity, 0.0, False
    report = {"first": float(x.sum()), "rounds": 0, "pivots": 0}
    while not done and cost @ x > (1 + gap) * bound and report["rounds"] < rounds:
        prices = cost @ inverse
        gain = pool @ prices - 1
        j, spare = int(gain.argmax()) if len(gain) else -1, int(prices.argmin())
        if j >= 0 and gain[j] > 1e-6 and gain[j] >= -prices[spare]:
            column, price = pool[j], 1.0
        elif prices[spare] < -1e-6:
            column, price = np.zeros(m), 0.0
            column[spare] = -1
        else:
            report["rounds"] += 1
            exact = np.maximum(prices, 0)
            new = np.zeros((0, m))
            for at in (exact if held is None else (exact + held) / 2, exact):
                best, took = priced(at, lengths, capacity)
                if at @ counts / best[capacity] > held_bound:
                    held, held_bound = at / best[capacity], at @ counts / best[capacity]
                promising = np.argsort(-(at + best[capacity - lengths]), kind="stable")[:columns]
                new = np.unique([best_pattern(took, lengths, capacity, int(i)) for i in promising], axis=0)
                new = new[new @ prices > 1 + 1e-6]
                if len(new):
                    break
            bound, done = max(bound, held_bound), not len(new)
            pool = np.concatenate([pool[gain > -0.3] if len(pool) > 4 * m else pool, new])
            continue
        step = inverse @ column
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        row, touched = inverse[out] / step[out], np.flatnonzero(np.abs(step) > 1e-12)
        inverse[touched] -= np.outer(step[touched], row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
        report["pivots"] += 1
    real = cost > 0
    return basis[:, real].astype(np.int64), x[real], report | {"objective": float(cost @ x), "bound": float(bound), "optimal": done}


def cutting_stock(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.001) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, which hold exactly `counts` pieces of `lengths` (ascending, distinct).

    The counts of the linear program's patterns are rounded down and what they hold beyond `counts` is taken out; what
    is left, less than one of each basic pattern, is packed best fit decreasing."""
    m = len(lengths)
    if not m:
        return []
    basis, x, _ = column_generation(lengths, counts, capacity, gap)
    used, left = [], counts.astype(np.int64).copy()
    for n, pattern in ((int(n + 1e-6), p) for n, p in zip(x, basis.T, strict=True)):
        while n > 0 and pattern.any():
            # whole patterns as long as all their lengths last, then the pattern without those that don't
            times = min(n, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times:
                used.append((times, pattern))
                left -= times * pattern
                n -= times
            pattern = np.minimum(pattern, left)
    bins: list[np.ndarray] = []
    room = np.zeros(0, np.int64)
    for i in range(m - 1, -1, -1):
        while left[i]:
            fits = np.where(room >= lengths[i], room, capacity + 1)
            b = int(fits.argmin()) if len(fits) and fits.min() <= capacity else len(bins)
            if b == len(bins):
                bins.append(np.zeros(m, np.int64))
                room = np.append(room, capacity)
            some = min(int(left[i]), int(room[b] // lengths[i]))
            bins[b][i] += some
            room[b] -= some * lengths[i]
            left[i] -= some
    return [*used, *((1, p) for p in bins)]


def histogram(lengths: np.ndarray, capacity: int, most: int = 256) -> np.ndarray:
    """The bin of each length, named by its longest length: single lengths if there are at most `most`, else the narrowest bins of a width 2, 4, ... that are at most `most`."""
    width = 1
    while len(np.unique(np.minimum(-(-lengths // width) * width, capacity))) > most:
        width *= 2
    return np.minimum(-(-lengths // width) * width, capacity)


def slots(patterns: list[tuple[int, np.ndarray]], bins: np.ndarray) -> list[tuple]:
    """For each bin and pattern (bin, first rank, end rank, copies in a sequence, first sequence)."""
    rank, rows, sequence = np.zeros(len(bins), np.int64), [], 0
    for n, pattern in patterns:
        for i in np.flatnonzero(pattern):
            a = int(pattern[i])
            rows.append((int(bins[i]), int(rank[i]), int(rank[i] + n * a), a, sequence))
            rank[i] += n * a
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, gap: float = 0.001) -> DataFrame:
    """token_pieces() with sequence_id (long, from 0) and offset (gapless from 0 within a sequence of at most `capacity`).

    Packing works on a histogram of at most 256 bins of lengths, in which a piece counts as its bin's longest, so the
    driver's work doesn't grow with the input. pieces must be a stored table, as each reading must give the same part
    and nth. At most `capacity` counts come to the driver; the slots sent back are a few for each bin. A sequence's
    pieces lie longest first. Equal pieces take places in the order of the tasks that made them. An empty table gives an empty result."""
    spark = pieces.sparkSession
    found = sorted(pieces.groupBy("length").count().collect())
    lengths, counts = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)
    of = histogram(lengths, capacity)
    bins, at = np.unique(of, return_inverse=True)
    table = slots(cutting_stock(bins, np.bincount(at, counts, len(bins)).astype(np.int64), capacity, gap), bins)
    # the rank in a bin: after the bin's shorter lengths, then after the same length's pieces of lower tasks, then nth
    shorter = np.cumsum(counts) - counts
    shorter -= shorter[np.searchsorted(of, of)]
    kinds = [(int(n), int(b), int(k)) for n, b, k in zip(lengths, of, shorter, strict=True)]
    by_bin = spark.createDataFrame(table, "bin long, lo long, hi long, copies long, sequence long").groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "copies", "sequence"))).alias("slots"))
    by_length = spark.createDataFrame(kinds, "length long, bin long, shorter long").join(F.broadcast(by_bin), "bin").drop("bin")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).join(F.broadcast(by_length), "length").withColumn("rank", F.col("shorter") + F.col("base") + F.col("nth"))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.withColumn("slot", slot).withColumn("sequence_id", F.col("slot.sequence") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.copies")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slots", "slot", "rank", "shorter", "base", "nth", "part")


def packed_documents(docs: DataFrame, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """docs' pieces with their places: tokenised once into a table in the shared folder, then packed.

    The ids are those of byte_bpe_50k.json: byte_bpe_50k.tiktoken is the same vocabulary, to which its special token is added."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, capacity=capacity, keep_ids=keep_ids)
    return pack(written(pieces, "pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_documents(documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
