"""Query understanding: synonyms, entities, replies of language models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_synonyms(queries: DataFrame, text: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """queries with expanded: the text and, for each known term in it, its synonyms that are not yet there.

    Longer terms come first and cover their span, so a term inside a longer one does not match again; matches end at
    word boundaries. Sequential over spans, so an Arrow-batched function."""
    groups: dict[str, list[str]] = {}
    for canonical, terms in synonyms.items():
        for t in {canonical, *terms}:
            groups.setdefault(t.lower(), [])
            groups[t.lower()] += [x for x in [canonical, *terms] if x.lower() != t.lower() and x not in groups[t.lower()]]
    ordered = sorted(groups, key=lambda t: (-len(t), t))

    def one(query: str | None) -> str | None:
        if query is None:
            return None
        low, taken, extra = query.lower(), [False] * len(query), []
        for term in ordered:
            at = low.find(term)
            while at >= 0:
                end = at + len(term)
                edge = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
                if edge and not any(taken[at:end]):
                    taken[at:end] = [True] * len(term)
                    extra += [x for x in groups[term] if x.lower() not in low.split() and x not in extra]
                at = low.find(term, at + 1)
        return " ".join([query, *extra])

    @F.pandas_udf("string")
    def expanded(batch: pd.Series) -> pd.Series:
        return batch.map(one, na_action="ignore")

    return queries.withColumn("expanded", expanded(F.col(text)))


def with_entities(text: Column, entities: Column) -> Column:
    """The text and all distinct entity strings of a map of arrays."""
    return F.concat_ws(" ", text, F.array_join(F.array_distinct(F.flatten(F.map_values(entities))), " "))


def found_entities(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """A map from type to the vocabulary's words in the text, without empty types."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = []
    for kind, some in vocabulary.items():
        pairs += [F.lit(kind), F.array_sort(F.array_intersect(words, F.array(*map(F.lit, some))))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0)


def checked_replies(expected: DataFrame, replies: DataFrame, key: str, fields: dict[str, list[str]]) -> DataFrame:
    """expected ids with the reply's fields: values outside the allowed ones become unknown; ids without a reply get unknown and dropped = true."""
    found = replies.groupBy(key).agg(*[F.min(f).alias(f) for f in fields], F.lit(False).alias("dropped"))
    out = expected.select(key).join(found, key, "left")
    cells = [F.when(F.col(f).isin(*allowed), F.col(f)).otherwise("unknown").alias(f) for f, allowed in fields.items()]
    return out.select(key, *cells, F.coalesce("dropped", F.lit(True)).alias("dropped"))
