"""Weak labels for entities: spans of known terms in texts, and tags of their tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "array<struct<type: string, term: string, start: int, end: int>>"


def automaton(vocabulary: dict[str, list[str]]) -> ahocorasick.Automaton:
    """All terms, lower-cased; a term of several types belongs to the first that has it."""
    found = ahocorasick.Automaton()
    for kind, terms in reversed(vocabulary.items()):
        for term in terms:
            if term:
                found.add_word(term.lower(), (kind, term.lower()))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case, character by character where that keeps the length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str, terms: ahocorasick.Automaton) -> list[dict]:
    """Longest terms first, of equally long ones the earliest; a span ends at word boundaries and overlaps none before it."""
    if not len(terms):
        return []
    low = lowered(text)
    word = lambda k: 0 <= k < len(low) and (low[k].isalnum() or low[k] == "_")
    hits = []
    for last, (kind, term) in terms.iter(low):
        start, end = last - len(term) + 1, last + 1
        if not (word(start - 1) and word(start)) and not (word(end) and word(end - 1)):
            hits.append((-len(term), start, end, kind, term))
    taken, chosen = bytearray(len(low)), []
    for _, start, end, kind, term in sorted(hits):
        if not taken[start] and not taken[end - 1]:  # no longer span lies inside a shorter one
            taken[start:end] = b"\1" * (end - start)
            chosen.append({"type": kind, "term": term, "start": start, "end": end})
    return sorted(chosen, key=lambda s: s["start"])


def with_spans(rows: DataFrame, vocabulary: dict[str, list[str]], text: str = "text", out: str = "spans") -> DataFrame:
    """rows with spans: type, term, start and end (characters, from 0, end exclusive) of the vocabulary's terms in the text; none for a null text.

    The vocabulary is a parameter that every task builds its automaton of; a text is scanned once, whatever its length."""

    @F.pandas_udf(SPAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = automaton(vocabulary)
        for batch in batches:
            yield batch.map(lambda t: spans_of(t, terms) if isinstance(t, str) else [])

    return rows.withColumn(out, found(F.col(text).cast("string")))


def with_tags(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """rows with tokens (runs of non-spaces) and tags: B-type for the first token that a span touches, I-type for its others, O for the rest."""

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, tags = [], []
            for value, found in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", value or "")]
                row, at = ["O"] * len(words), 0
                for s in found or []:
                    first = True
                    while at < len(words) and words[at][1] <= s["start"]:
                        at += 1
                    for k in range(at, len(words)):
                        if words[k][0] >= s["end"]:
                            break
                        if row[k] == "O":
                            row[k] = ("B-" if first else "I-") + s["type"]
                        first = False
                tokens.append([w for _, _, w in words])
                tags.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))], [*batch.schema.names, "tokens", "tags"])

    words = T.ArrayType(T.StringType())
    return rows.mapInArrow(tagged, T.StructType([*rows.schema.fields, T.StructField("tokens", words), T.StructField("tags", words)]))


def type_stats(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """type, n (spans), n_rows, mean_length (characters) over all spans, and multi_share: the share of its rows with another type too."""
    kinds = F.array_distinct(F.transform(spans, lambda s: s["type"]))

    def of(kind: Column) -> Column:
        mine = F.filter(spans, lambda s: s["type"] == kind)
        length = F.aggregate(mine, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        return F.struct(kind.alias("type"), F.size(mine).alias("n"), length.alias("length"), (F.size(kinds) > 1).alias("multi"))

    each = rows.select(F.explode(F.transform(kinds, of)).alias("k")).select("k.*")
    return each.groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"), (F.sum("length") / F.sum("n")).alias("mean_length"), F.avg(F.col("multi").cast("double")).alias("multi_share"))
