"""Token counts by rank-synchronous array merging.

A text becomes runs that no piece of the vocabulary crosses (a run starts at each group of space marks). The
unseen runs of a batch are held as one ragged numpy array of symbols; in each round every run applies its
lowest-rank pair, all runs at once, until none has a pair; what counts is the symbols that survive. A run longer than
the vocabulary's longest piece applies, in one round, each pair that has no pair of a lower rank within such a
piece's length: no earlier merge can reach it, so the result is that of merging the lowest rank of the whole run
first, and the rounds don't grow with the run. Counts of runs are kept, so frequent runs are merged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, resident, slices

SPACE = "▁"
NONE = np.int64(1) << 40


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model with byte fallback makes of texts.

    Null and empty texts have no pieces. keep bounds the bytes that remembered runs take, about; runs beyond 64 characters aren't remembered."""

    def __init__(self, model_file: str, keep: int = 32 << 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        rank: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                rank[model.id_to_piece(i)] = i
        scores = {p: -model.get_score(i) for p, i in rank.items()}
        if any(SPACE in p.lstrip(SPACE) for p in rank):
            raise ValueError("pieces of this model cross spaces")
        symbols = {s: i for i, s in enumerate(sorted({*rank, *(c for p in rank for c in p)}))}
        # what a symbol costs if it survives: one piece, or its bytes where the vocabulary lacks it
        self.cost = np.array([1 if s in rank else len(s.encode()) for s in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.size = np.int64(len(symbols))
        pairs = [(symbols[p[:k]] * len(symbols) + symbols[p[k:]], scores[p], symbols[p]) for p in rank for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs] + [-1], np.int64)
        self.ranks = np.array([x[1] for x in pairs] + [NONE], np.int64)
        self.made = np.array([x[2] for x in pairs] + [0], np.int64)
        self.reach = max(map(len, rank), default=1)
        # a pair may merge at all its places at once if no pair with the symbol that it makes comes before it
        first = np.full(len(symbols), NONE)
        np.minimum.at(first, self.keys[:-1] // self.size, self.ranks[:-1])
        np.minimum.at(first, self.keys[:-1] % self.size, self.ranks[:-1])
        self.all_at_once = first[self.made] > self.ranks
        # pairs by a hash of their key; those whose slot another pair holds are found by bisection
        self.slots = np.full(1 << 20, -1)
        places = np.arange(len(pairs))
        self.slots[self.slot(self.keys[:-1])] = places
        clash = self.slots[self.slot(self.keys[:-1])] != places
        self.clashing, self.clashing_at = np.append(self.keys[:-1][clash], NONE << 20), np.append(places[clash], -1)
        self.held = np.zeros(1 << 20, bool)  # the slots where a miss may be a clash
        self.held[self.slot(self.clashing[:-1])] = True
        self.memo: dict[str, int] = {}
        self.keep = keep

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def merged(self, runs: list[str]) -> np.ndarray:
        """The number of pieces of each run."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        points = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.of_char[points]
        run = np.repeat(np.arange(len(runs)), lengths)
        utf8 = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        total = np.bincount(run, np.where(symbol < 0, utf8, 0), len(runs)).astype(np.int64)
        # an unknown character never merges: it ends a run, so what lies on its sides are runs of their own
        part = np.cumsum(np.concatenate(([0], (run[1:] != run[:-1]) | (symbol[1:] < 0) | (symbol[:-1] < 0)))) if len(run) else run
        known = symbol >= 0
        symbol, part, run = symbol[known], part[known], run[known]
        inner = part[1:] == part[:-1]
        at = np.full(len(symbol), -1)  # the place of the pair that starts at each symbol
        at[:-1][inner] = self.pair_places(symbol[:-1][inner], symbol[1:][inner])
        while len(symbol):
            rank = self.ranks[at]  # of -1: NONE
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sizes = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(rank, starts)
            best, done = np.repeat(lowest, sizes), np.repeat(lowest == NONE, sizes)
            if sizes.max() > 2 * self.reach:
                near = np.repeat(sizes > 2 * self.reach, sizes)
                best[near] = self.lowest_near(rank[near], part[near])
            if done.any():  # these runs are done and leave
                total += np.bincount(run[done], self.cost[symbol[done]], len(total)).astype(np.int64)
                go = ~done
                symbol, part, run, at, rank, best = symbol[go], part[go], run[go], at[go], rank[go], best[go]
            go = (rank == best) & (rank < NONE)
            hit = np.flatnonzero(go)
            if not len(hit):
                break
            if sizes.max() > 2 * self.reach:  # equal pairs in a row merge from the first one on: they wait for it
                row = np.cumsum(np.concatenate(([True], (rank[1:] != rank[:-1]) | (part[1:] != part[:-1]))))
                waits = np.maximum.accumulate(np.where(go, 0, row)) == row
                hit = hit[~waits[hit]]
            # of places that overlap, as in aaa, the first, third, ... merge; a pair with exceptions merges at its first place
            chain = np.concatenate(([True], np.diff(hit) > 1))
            odd = (np.arange(len(hit)) - np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))) & 1
            # first in its part, or of a rank that no pair before it within reach has
            leads = np.concatenate(([True], (part[hit[1:]] != part[hit[:-1]]) | (hit[1:] - hit[:-1] > self.reach)))
            hit = hit[leads | (self.all_at_once[at[hit]] & (odd == 0))]
            symbol[hit] = self.made[at[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            hit -= np.arange(len(hit))
            symbol, part, run, at = symbol[stay], part[stay], run[stay], at[stay]
            for left in (hit, hit[hit > 0] - 1):  # only the pairs of the new symbols change
                last = left == len(symbol) - 1
                right = np.where(last, left, left + 1)
                at[left] = np.where(last | (part[left] != part[right]), -1, self.pair_places(symbol[left], symbol[right]))
        return total

    def lowest_near(self, rank: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The lowest rank within `reach` places on either side, in the same part: by doubling windows."""
        padded = np.full(len(rank) + (self.reach + 1) * (len(np.unique(part)) + 1), NONE)
        place = np.arange(len(rank)) + (self.reach + 1) * np.cumsum(np.concatenate(([1], part[1:] != part[:-1])))
        padded[place] = rank
        window, width = padded, 1
        while 2 * width <= 2 * self.reach + 1:
            window = np.minimum(window, np.append(window[width:], np.full(width, NONE)))
            width *= 2
        left = place - self.reach
        return np.minimum(window[left], window[place + self.reach + 1 - width])

    def pair_places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the table of pairs of each two symbols, or -1."""
        key = left * self.size + right
        at = self.slots[self.slot(key)]
        at[self.keys[at] != key] = -1
        miss = np.flatnonzero((at < 0) & self.held[self.slot(key)])
        if len(miss):
            again = np.minimum(np.searchsorted(self.clashing, key[miss]), len(self.clashing) - 1)
            at[miss] = np.where(self.clashing[again] == key[miss], self.clashing_at[again], -1)
        return at

    def counts(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            if not text:
                split.append([])
                continue
            marked = text.replace(" ", SPACE)
            # without double spaces each run is one space mark and a word, known by its word alone
            split.append(re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + marked) if SPACE + SPACE in marked or marked[0] == SPACE else marked.split(SPACE))
        memo = self.memo
        if 200 * len(memo) > self.keep:  # a run of at most 64 characters, its count and their places in the table
            memo.clear()
        unseen = list(set().union(*split).difference(memo))
        for i in range(0, len(unseen), 50_000):
            some = unseen[i : i + 50_000]
            memo.update(zip(some, self.merged([w if w[:1] == SPACE else SPACE + w for w in some]).tolist(), strict=True))
        counted = [sum(map(memo.__getitem__, runs)) for runs in split]
        for run in unseen:
            if len(run) > 64:
                del memo[run]
        return counted


def count_pieces(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are kept as they are; columns other than
    the two named are not read. An empty table gives an empty result. One pass over the texts, no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("pieces", model_file), lambda: PieceCounter(model_file))
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                counts = counter.counts(texts)
                yield pa.record_batch([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = mapped(rows, each, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
