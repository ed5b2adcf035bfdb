"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features, those of the lines beside it and the transition between labels weigh in; the
marginals of the forward-backward algorithm, weighted by the lines' lengths, give the document's share of good text,
which a logistic curve turns into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held_out, labels, mapped, sampled, slices
from .hashing import runs

N_OWN = 12
#: Lines whose features are held at once.
LINES = 1 << 14
# of each byte: symbol, upper case, lower case or not ASCII, digit, pipe, exclamation mark, or anything else
_CLASS = np.full(256, 6, np.int64)
_CLASS[[ord(c) for c in "#*$%&<>=@^~\\{}[]_"]] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FEED = np.zeros(256, bool)
_FEED[10] = True


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each line begins and ends, and where each text's lines begin (one more than texts).

    A text has a line more than it has line feeds; null counts as empty."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return data, starts, ends, np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The features of the lines by themselves, in blocks of LINES lines."""
    last = 0
    for a in range(0, len(starts), LINES):
        begin, end = starts[a : a + LINES], ends[a : a + LINES]
        base, m = begin[0], len(begin)
        part = data[base : end[-1] + 1]
        begin, end = begin - base, end - base
        length = end - begin
        counts = np.zeros((m, 7), np.int64)
        for at in range(0, len(part), 1 << 18):
            some = part[at : at + (1 << 18)]
            first = np.searchsorted(begin, at, side="right") - 1
            of = np.cumsum(some == 10) - (some == 10)
            here = np.bincount(of * 7 + _CLASS[some]).astype(np.int64)
            here = np.append(here, np.zeros(-len(here) % 7, np.int64)).reshape(-1, 7)
            counts[first : first + len(here)] += here
        w0, w1, word = runs(part, _SPACE)
        l0, _, value = runs(part, _FEED)
        line = np.zeros(m, np.uint64)  # an empty line has no hash
        line[np.searchsorted(begin, l0)] = value
        of = np.searchsorted(begin, w0, side="right") - 1
        n = np.bincount(of, minlength=m)
        again, again2 = np.zeros(len(word), bool), np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        again2[2:] = (word[2:] == word[:-2]) & (of[2:] == of[:-2])
        long = np.bincount(of, (w1 - w0) > 12, m)
        same = (line == np.concatenate((np.array([last], np.uint64), line[:-1]))) & (length > 0)
        last = line[-1]
        some, letters = np.maximum(n, 1), np.maximum(counts[:, 1] + counts[:, 2], 1)
        yield np.column_stack([
            np.minimum(counts[:, 0] / some, 3), counts[:, 1] / letters, counts[:, 3] / np.maximum(length, 1), counts[:, 4] / some, np.minimum(counts[:, 5] / some, 2),
            np.bincount(of, again, m) / some, np.bincount(of, again2, m) / some, long / some, same, np.log1p(n) / 5, n == 0, np.ones(m),
        ])


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, every line's length in bytes, and where each text's lines begin (one more than texts)."""
    data, starts, ends, doc = lines_of(texts)
    return np.concatenate(list(own_features(data, starts, ends))), ends - starts, doc


def beside(emit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The weights of each line's labels: what its own features, the line before and the line after give (lines x 3 x 2; nothing from beyond a text)."""
    out = emit[:, 0].copy()
    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:], after[:-1] = emit[:-1, 1], emit[1:, 2]
    before[doc[:-1]] = 0
    after[doc[1:] - 1] = 0
    return out + before + after


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features, then the previous line's and the next line's (zeros at the ends of a text)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[doc[:-1]] = 0
    after[doc[1:] - 1] = 0
    return np.hstack([own, before, after])


def marginals(emit: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(label) of every line, the expected count of each transition, and the sum of the texts' log partition functions.

    All texts advance together: step t handles line t of every text that has one."""
    n = np.diff(doc)
    order = np.argsort(-n, kind="stable")
    first, size = doc[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(steps):
        at = first[: active[t]] + t
        forward[at] = emit[at]
        if t:
            old = forward[at - 1]
            forward[at] += np.logaddexp(old[:, :1] + move[0], old[:, 1:] + move[1])
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = emit[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    last = doc[1:] - 1
    whole = np.logaddexp(forward[last, 0], forward[last, 1])
    of = np.repeat(np.arange(len(n)), n)
    node = np.exp(forward + backward - whole[of][:, None])
    inner = np.ones(len(emit), bool)
    inner[doc[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(forward[at - 1][:, :, None] + move[None] + (emit[at] + backward[at])[:, None, :] - whole[of[at]][:, None, None])
    return node, pair.sum(axis=0), float(whole.sum())


def fit(texts: list[str], quality: list[int], prior: dict[int, int], rounds: int = 120) -> dict | None:
    """Weights by gradient ascent (Adam) on the likelihood of the lines, each labelled as its text is, classes weighing alike;
    then the logistic curve, classes weighing as `prior` counts them. None if a class is missing."""
    if len(set(quality)) < 2:
        return None
    own, length, doc = line_features(texts)
    mean, spread = own.mean(axis=0), own.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    x = with_neighbours((own - mean) / spread, doc)
    y = np.array(quality)
    line = np.repeat(y, np.diff(doc))
    want = np.column_stack([line == 0, line == 1]).astype(float)
    inner = np.ones(len(line), bool)
    inner[doc[:-1]] = False
    stays = np.zeros((2, 2))
    np.add.at(stays, (line[inner], line[inner]), 1.0)
    weight, move = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (weight, move)]
    for step in range(1, rounds + 1):
        node, pair, _ = marginals(x @ weight, move, doc)
        grads = (x.T @ (want - node) / len(x) - 1e-3 * weight, (stays - pair) / len(x) - 1e-3 * move)
        for w, g, s in zip((weight, move), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            w += 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    model = {"mean": mean, "spread": spread, "weight": weight, "move": move, "a": 1.0, "b": 0.0}
    share = logit(good_share(model, [own], length, doc))
    each = np.where(y == 1, prior[1] / (y == 1).sum(), prior[0] / (y == 0).sum())
    each /= each.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton's steps, damped
        p = 1 / (1 + np.exp(-(a * share + b)))
        g = np.array([(each * (y - p) * share).sum() - 1e-4 * a, (each * (y - p)).sum()])
        h = each * p * (1 - p)
        m = np.array([[(h * share**2).sum() + 1e-4, (h * share).sum()], [(h * share).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) + 0.5 * np.linalg.solve(m, g)
    return model | {"a": float(max(a, 1e-3)), "b": float(b)}


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def good_share(model: dict, own: Iterable[np.ndarray], length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The share of each text's bytes that lies in good lines; own: the lines' features in blocks."""
    weight = model["weight"].reshape(3, N_OWN, 2).transpose(1, 0, 2).reshape(N_OWN, 6)
    emit = np.concatenate([((x - model["mean"]) / model["spread"]) @ weight for x in own]).reshape(-1, 3, 2)
    node, _, _ = marginals(beside(emit, doc), model["move"], doc)
    size = np.maximum(length, 1).astype(float)
    return np.add.reduceat(node[:, 1] * size, doc[:-1]) / np.add.reduceat(size, doc[:-1])


def scores(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    data, starts, ends, doc = lines_of(texts)
    share = good_share(model, own_features(data, starts, ends), ends - starts, doc)
    return 1 / (1 + np.exp(-(model["a"] * logit(share) + model["b"])))


def learn(docs: DataFrame, labelled: DataFrame, per_class: int = 1000, passages: int = 8, characters: int = 4096) -> dict | None:
    """A model from at most per_class texts of each quality among docs' rows that `labelled` (doc_id, quality) names and that are not held out.

    A sampled text of up to `passages` passages of `characters` characters is learned from whole, a longer one from so
    many passages that lie anywhere in it, chosen by hash. Null ids and qualities other than 0 and 1 are left out; of
    the texts of a repeated id one counts, chosen by hash. The sample is chosen on ids and labels alone, so its join to
    the texts broadcasts 2 * per_class rows at most, and as many come to the driver."""
    usable = labelled.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    prior = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    chosen = sampled(usable, "quality", per_class)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % characters), F.lit(0))
    ordered = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i"), p.alias("p"))))
    some = F.when(F.length(text) <= passages * characters, F.array(text)).otherwise(F.transform(F.array_sort(F.transform(F.slice(ordered, 1, passages), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), some.alias("texts"))).alias("one"))
    found = sorted((r["doc_id"], r["quality"], t) for r in rows.select("doc_id", "quality", "one.texts").collect() for t in r["texts"])
    return fit([t for *_, t in found], [q for _, q, _ in found], prior)


def score_quality(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns `keep` of docs and score_col (0 to 1), one row for each row; one of `keep` that has its name is replaced.

    Empty and null texts have one empty line and so the score that the model gives that; without a model every score
    is 0.5. Repeated rows and ties are scored each for itself, alike. Only `keep` and the text are read; one pass, no
    shuffle; memory is bounded by LINES lines, about 100 bytes a line of the longest text, and a slice. An empty table gives an empty result."""
    keep = [c for c in keep if c != score_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                yield pa.record_batch([part.column(0), pa.array(scores(model, part.column(1).to_pylist()), pa.float64())], names=["row", "score"])

    scored = mapped(rows, each, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select("row.*", F.col("score").alias(score_col))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, learn(docs, labels(spark, sf_dir)), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
