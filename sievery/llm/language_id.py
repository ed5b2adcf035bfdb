"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into phrases, each the longest match
that the automaton has from where the last one ended; the language that needs the fewest phrases a symbol, scaled by
the logarithm of how much text it learned from, wins. The texts of a slice are parsed in lockstep, long ones in
blocks: one numpy step moves every block, in every language, by a symbol. A block is parsed as if a phrase began with
it, and then again from the state that the block before it ends in, until both parses begin a phrase at the same place,
so that the count is that of one parse of the whole text.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, mapped, resident, sampled, slices

#: Symbols of a text that are parsed together.
BLOCK = 1024
#: Symbols: a break between texts, a gap, the most frequent letters, first symbols of letters of two and of three symbols, and a letter that no language has learned.
BREAK, GAP, FREQUENT, TWO, THREE, UNKNOWN, WIDTH = 0, 1, 2, 42, 62, 63, 64


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: next state by state and symbol; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return nexts


def coded(rank: int | None) -> tuple[int, int, int]:
    """The symbols (-1: none) of the letter of a rank by frequency, so that no learned letter is merged with another up to rank 5,123; letters beyond share symbols."""
    if rank is None:
        return UNKNOWN, -1, -1
    rare, rarer = rank - (TWO - FREQUENT), rank - (TWO - FREQUENT) - (THREE - TWO) * 62
    if rare < 0:
        return FREQUENT + rank, -1, -1
    if rarer < 0:
        return TWO + rare // 62, FREQUENT + rare % 62, -1
    return THREE, FREQUENT + rarer // 62 % 62, FREQUENT + rarer % 62


class CrossParser:
    """Parses texts against every language of a model (language -> learned texts)."""

    def __init__(self, model: dict[str, list[str]]):
        self.languages = sorted(model)
        seen = Counter(c.lower()[:1] for texts in model.values() for t in texts for c in t if c.isalpha())
        rank = {c: r for r, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        self.letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        self.code = np.full((0x110000, 3), -1, np.int8)
        self.code[:, 0] = GAP
        for p in np.flatnonzero(self.letter).tolist():
            self.code[p] = coded(rank.get(chr(p).lower()[:1]))
        starts, at, learned, tables = [], 0, [], []
        for language in self.languages:
            symbols: list[int] = []
            for text in model[language]:
                symbols += [*self.symbols(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist(), BREAK]
            states = automaton(symbols)
            table = np.full(len(states) * WIDTH, -1, np.int32)
            table[[state * WIDTH + s for state, moves in enumerate(states) for s in moves]] = [to + at for moves in states for to in moves.values()]
            tables.append(table)
            starts.append(at)
            at += len(states)
            learned.append(len(symbols))
        tables.append(np.full(WIDTH, -1, np.int32))
        self.table = np.concatenate(tables)
        self.starts = np.array(starts, np.int64)
        self.none = at  # a state without moves: the next symbol begins a phrase
        self.scale = np.log2(np.maximum(learned, 4)) if learned else np.zeros(0)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of the letters; runs of anything else become one gap."""
        code = self.code[points]
        code = code[:, 0] if len(code) and code[:, 1].max() < 0 else code[code >= 0]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != GAP) | (code[:-1] != GAP)
        return code[keep]

    def step(self, state: np.ndarray, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and where it begins a phrase. A symbol that a language lacks is a phrase of its own."""
        to = self.table[state * WIDTH + symbol]
        lost = to < 0
        again = self.table[start[lost] * WIDTH + symbol[lost]]
        to[lost] = np.where(again < 0, self.none, again)
        return to, lost

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text needs in each language."""
        n = len(self.languages)
        out = np.zeros((len(texts), n), np.int64)
        blocks = [(i, k, t[k : k + BLOCK]) for i, t in enumerate(texts) for k in range(0, len(t), BLOCK)]
        if not blocks or not n:
            return out
        blocks.sort(key=lambda b: -len(b[2]))
        lengths = np.array([len(b) for *_, b in blocks])
        grid = np.zeros((int(lengths[0]), len(blocks)), np.int32)
        for j, (_, _, b) in enumerate(blocks):
            grid[: len(b), j] = b
        # a unit is a block in a language
        start, of = np.tile(self.starts, len(blocks)), np.repeat(np.arange(len(blocks)), n)
        state, count = np.full(len(start), self.none, np.int32), np.zeros(len(start), np.int64)
        active = n * np.searchsorted(-lengths, -np.arange(len(grid)), side="left")
        begun = np.zeros((len(grid), len(start)), bool)
        for t in range(len(grid)):
            a = int(active[t])
            state[:a], begun[t, :a] = self.step(state[:a], grid[t, of[:a]], start[:a])
            count[:a] += begun[t, :a]
        # a block that goes on with a text: the parse from its true state differs until both begin a phrase at one place
        place = {(i, k): j for j, (i, k, _) in enumerate(blocks)}
        before = np.array([place.get((i, k - BLOCK), -1) for i, k, _ in blocks])
        after = np.array([place.get((i, k + BLOCK), -1) for i, k, _ in blocks])
        more = np.zeros(len(start), np.int64)  # phrases of the true parse less those of the first one
        final = state.copy()
        units = np.flatnonzero(before[of] >= 0)
        while len(units):
            alive, now = units, final[before[of[units]] * n + units % n]
            more[units], last, t = 0, final.copy(), 0
            final[units] = state[units]
            while len(alive):
                over = t >= lengths[of[alive]]
                final[alive[over]] = now[over]  # the block is over before the parses meet
                alive, now = alive[~over], now[~over]
                if len(alive):
                    now, lost = self.step(now, grid[t, of[alive]], start[alive])
                    more[alive] += lost.astype(np.int64) - begun[t, alive]
                    apart = ~(lost & begun[t, alive])
                    alive, now = alive[apart], now[apart]
                t += 1
            moved = np.flatnonzero(final != last)
            moved = moved[after[of[moved]] >= 0]
            units = after[of[moved]] * n + moved % n  # what follows a block that ends in another state now
        np.add.at(out, [i for i, *_ in blocks], (count + more).reshape(-1, n))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        some = [bool(self.letter[p].any()) for p in points]
        parts = [self.symbols(p) if s else p[:0].astype(np.int8) for p, s in zip(points, some, strict=True)]
        rates = self.phrases(parts) * self.scale / np.maximum([len(c) for c in parts], 1)[:, None]
        labels, scores = [], []
        for has, rate in zip(some, rates, strict=True):
            if not has or not self.languages:
                labels.append("und")
                scores.append(0.0)
                continue
            best = int(rate.argmin())
            rest = np.delete(rate, best)
            labels.append(self.languages[best])
            scores.append(float(1 - rate[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
        return labels, scores


def learn(rows: DataFrame, per_language: int = 128, passages: int = 4, characters: int = 512, symbols: int = 40_000) -> dict[str, list[str]]:
    """A model from (id, text, lang) rows: of at most per_language texts of each language, chosen by hash, up to `passages` passages of `characters` characters that lie anywhere in the text, `symbols` characters of each language.

    Every text's first choice counts before the second ones. Every letter in them counts. Rows with a
    null id, text or lang are left out; repeated rows count once. What comes to the driver is bounded for each language."""
    usable = rows.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").withColumn("row", F.xxhash64("id", "text"))
    chosen = sampled(usable.select("row", "lang"), "lang", per_language, "row")
    parts = F.transform(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % characters), F.lit(0)), lambda p, i: F.struct(F.xxhash64("row", i).alias("h"), p.alias("p")))
    texts = usable.join(F.broadcast(chosen), ["lang", "row"]).select("lang", "row", F.slice(F.array_sort(parts), 1, passages).alias("parts"))
    found = texts.groupBy("lang", "row").agg(F.min("parts").alias("parts")).select("lang", F.posexplode("parts").alias("nth", "part")).select("lang", "nth", "part.h", "part.p").collect()
    model: dict[str, list[str]] = {}
    for lang, _, _, passage in sorted(map(tuple, found)):
        mine = model.setdefault(lang, [])
        if sum(map(len, mine)) + len(passage) <= symbols:
            mine.append(passage)
    return model


def identify(docs: DataFrame, model: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row of docs: `und` and 0 for a text that is null or has no letter, otherwise a learned language and how far ahead of the next it is (0 to 1).

    Equal rates go to the first language by code point. Only the two columns are read; whole texts are parsed in one
    pass without a shuffle. Where nothing could be learned every text is `und`. An empty table gives an empty result."""
    packed = json.dumps(model, sort_keys=True)
    name = hashlib.md5(packed.encode()).hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = resident(("languages", name), lambda: CrossParser(json.loads(packed)))
        for batch in batches:
            for part in slices(batch, 1):
                labels, scores = parser.predict(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
