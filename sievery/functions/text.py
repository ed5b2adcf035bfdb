"""Text expressions: cleaning, templates, tokens, buckets, flags and rule chains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = ("", "nan", "none", "unknown")


def cleaned(c: Column) -> Column:
    """Trimmed, and null if blank or one of the words that stand for nothing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*BLANKS), t)


def article_text(fields: list[Column], last_limit: int = 200, sep: str = " | ") -> Column:
    """The cleaned fields joined by sep; the last one cut to last_limit characters."""
    parts = [cleaned(f) for f in fields[:-1]] + [F.substring(cleaned(fields[-1]), 1, last_limit)]
    return F.concat_ws(sep, *parts)


def tagged_text(name: Column, detail: Column, tags: list[tuple[str, Column]], limit: int = 150) -> Column:
    head = F.concat_ws(" | ", cleaned(name), F.substring(cleaned(detail), 1, limit))
    return F.concat_ws(" ", head, *[F.concat(F.lit(f"[{k}] "), cleaned(v)) for k, v in tags])


def captions(templates: list[Column], fallback: Column, most: int = 4) -> Column:
    """The first `most` non-null templates, or the fallback alone."""
    found = F.slice(F.filter(F.array(*templates), lambda x: x.isNotNull()), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_with_clitics(c: Column) -> Column:
    """Lower-case words and numbers; an apostrophe joins what letters follow it."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def tokens_with_hyphens(c: Column) -> Column:
    """Lower-case words and numbers, hyphens and apostrophes inside them included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))


def letter_tokens(c: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)


def keywords(c: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's words among the text's tokens, and its phrases of several words anywhere in the text, sorted."""
    single, several = [v for v in vocabulary if " " not in v], [v for v in vocabulary if " " in v]
    found = F.array_intersect(tokens_with_hyphens(c), F.array(*map(F.lit, single)).cast("array<string>"))
    phrases = F.filter(F.array(*map(F.lit, several)).cast("array<string>"), lambda v: F.contains(F.lower(c), v))
    return F.array_sort(F.concat(found, phrases))


def first_class(c: Column, classes: list[tuple[str, list[str]]], otherwise: tuple[str, str] = ("other", "general")) -> Column:
    """struct(category, keyword) of the first token, in the text's order, that is a keyword of any class; a word of several classes counts for the first."""
    of = {w: name for name, some in reversed(classes) for w in some}
    table = F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair])
    first = F.get(F.filter(tokens_with_hyphens(c), lambda t: F.map_contains_key(table, t)), 0)
    return F.struct(F.coalesce(F.element_at(table, first), F.lit(otherwise[0])).alias("category"), F.coalesce(first, F.lit(otherwise[1])).alias("keyword"))


def drawn(pool: list[str], seed: str, *parts: Column | str) -> Column:
    """One of the pool, by the MD5 of seed and parts: the same in any engine."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, pool)), (number % len(pool) + 1).cast("int"))


def filled_template(template: str, pools: dict[str, list[str]], seed: str, key: Column) -> Column:
    """The template with each {slot} replaced by a draw from its pool; a slot's second occurrence draws anew."""
    parts, seen = [], {}
    for k, piece in enumerate(re.split(r"[{}]", template)):
        if k % 2:
            seen[piece] = seen.get(piece, 0) + 1
            parts.append(drawn(pools[piece], seed, f"{piece}{seen[piece]}", key))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "[ \t\n\r]+"), lambda w: w != ""))


def length_bucket(n: Column, short: int = 8, medium: int = 25) -> Column:
    return F.when(n <= short, "short").when(n <= medium, "medium").otherwise("long")


def token_bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def first_rule(words: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The name of the first rule of which a word occurs."""
    found = F.lit(otherwise)
    for name, some in reversed(rules):
        found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, some))), name).otherwise(found)
    return found


def rules_met(conditions: list[tuple[str, Column]]) -> Column:
    """The names of all conditions that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]), lambda x: x.isNotNull())


def first_reason(conditions: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in conditions])


def json_object(c: Column) -> Column:
    """From the first { to the last }, without code fences; null if there is none."""
    found = F.regexp_extract(c, "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def grounded(values: Column, text: Column) -> Column:
    """Only those values that occur in the text, whatever their case."""
    return F.filter(values, lambda v: F.contains(F.lower(text), F.lower(v)))


def relative_delta(value: Column, base: Column) -> Column:
    """100 * (value - base) / base, null where base is 0."""
    return F.try_divide(100.0 * (value - base), base)


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by |: the same in any engine."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def content_name(*parts: Column) -> Column:
    """The first 24 hexadecimal digits of the parts' SHA-256: a file's name by its content."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24)
