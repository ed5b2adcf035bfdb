"""Fill-in-the-middle: a text is cut at unit boundaries into prefix, middle and suffix, which change places between sentinels.

A table-driven automaton over bytes knows continuation bytes of UTF-8, starts of units (lines) and sentinels at once.
Its one scan emits a code for each transition; the codes are counted for each text. A second pass locates the cuts:
it goes back only to the blocks of bytes in which one lies, from the state and the counts at the block's start. Many
lanes of a block step through the table together: the state depends on the last few bytes only, so that each lane
finds its own by reading these before its first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that are scanned together, and how many of them a lane takes.
BLOCK, LANE = 1 << 20, 512
#: Bits of a transition's code: a code point begins, a unit begins, a sentinel ends.
POINT, UNIT, FOUND = 1, 2, 4


class Automaton:
    """The table for some sentinels: states are the longest sentinel prefix just read, and whether a unit begins next.

    Bytes that behave alike share a class; each class has a second number for a text's first byte, which forgets what
    came before."""

    def __init__(self, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        prefixes = sorted({m[:k] for m in marks for k in range(len(m) + 1)}, key=lambda p: (len(p), p))
        own = set(b"".join(marks))
        kinds = [(0x80 <= b < 0xC0, b == 10, b if b in own else -1) for b in range(256)]
        names = sorted(set(kinds))
        self.class_of = np.array([names.index(k) for k in kinds], np.uint8)
        self.classes, self.depth = len(names), max(map(len, marks)) if marks else 1
        width = 2 * self.classes
        self.next, self.code = np.zeros(2 * len(prefixes) * width, np.intp), np.zeros(2 * len(prefixes) * width, np.uint8)
        for kind, number in ((k, names.index(k)) for k in names):
            byte = bytes([next(b for b in range(256) if kinds[b] == kind)])
            for state in range(2 * len(prefixes)):
                for first in (0, 1):
                    read, begins = (b"", True) if first else (prefixes[state // 2], bool(state % 2))
                    tail = read + byte
                    longest = next(tail[k:] for k in range(len(tail) + 1) if tail[k:] in prefixes)
                    at = state * width + first * self.classes + number
                    self.next[at] = width * (2 * prefixes.index(longest) + kind[1])
                    self.code[at] = POINT * (not kind[0]) + UNIT * begins + FOUND * any(tail.endswith(m) for m in marks)

    def scan(self, data: np.ndarray, firsts: np.ndarray, at: int, state: int) -> tuple[np.ndarray, int]:
        """The codes of the block of data from `at` on, and the state after it; firsts: ascending places of first bytes of texts."""
        end = min(at + BLOCK, len(data))
        kinds = self.class_of[data[at:end]]
        kinds[firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, end)] - at] += np.uint8(self.classes)
        lanes = -(-len(kinds) // LANE)
        rest = lanes * LANE - len(kinds)
        steps = np.ascontiguousarray(np.concatenate((kinds, np.zeros(rest, np.uint8))).reshape(lanes, LANE).T)
        states = np.zeros(lanes, np.intp)
        for k in range(LANE - self.depth, LANE):
            states[1:] = self.next[states[1:] + steps[k, :-1]]
        states[0] = state
        codes = np.empty((LANE, lanes), np.uint8)
        for k in range(LANE):
            place = states + steps[k]
            np.take(self.code, place, out=codes[k])
            states = self.next[place]
            if k == LANE - rest - 1:
                after = int(states[-1])
        return codes.T.reshape(-1)[: len(kinds)], after


def before(flags: np.ndarray) -> np.ndarray:
    """How many of the flags lie before each place, the end included."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(flags != 0, dtype=np.int64)))


class Texts:
    """Texts one after the other in `data`, text k from edges[k] to edges[k + 1]: their counts of points, units and sentinels."""

    def __init__(self, table: Automaton, data: np.ndarray, edges: np.ndarray):
        self.table, self.data, self.edges = table, data, edges
        self.firsts = np.unique(edges[:-1][edges[:-1] < edges[1:]])
        at_edges, total, state, self.starts, self.last = np.zeros((3, len(edges)), np.int64), np.zeros(3, np.int64), 0, [], None
        for at in range(0, len(data), BLOCK):
            codes, after = table.scan(data, self.firsts, at, state)
            here = (edges > at) & (edges <= at + len(codes))
            sums = [before(codes & bit) for bit in (POINT, UNIT, FOUND)]
            for row, counts, base in zip(at_edges, sums, total, strict=True):
                row[here] = base + counts[edges[here] - at]
            self.starts.append((at, state, *total[:2]))
            total, state, self.last = total + [c[-1] for c in sums], after, (at, codes)
        self.points, self.units, found = at_edges
        self.n = np.diff(self.units)
        self.marked = np.diff(found) > 0

    def located(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units begin, in bytes of data and in code points of all texts; a text's end where it has no such unit."""
        ends = unit >= self.n[text]
        byte, point = self.edges[text + 1].copy(), self.points[text + 1].copy()
        wanted = self.units[text] + unit
        bases = np.array([b[3] for b in self.starts] or [0])
        block = np.searchsorted(bases, wanted, side="right") - 1
        for k in np.unique(block[~ends]):
            at, state, points, units = self.starts[k]
            codes = self.last[1] if self.last[0] == at else self.table.scan(self.data, self.firsts, at, state)[0]
            mine = np.flatnonzero(~ends & (block == k))
            place = np.flatnonzero(codes & UNIT)[wanted[mine] - units]
            byte[mine], point[mine] = at + place, points + before(codes & POINT)[place]
        return byte, point


def checked(sentinels: tuple[str, ...]) -> list[bytes]:
    """The three sentinels as bytes; raises unless none holds or runs into another, so that an output has one reading."""
    marks = [s.encode() for s in sentinels]
    if len(marks) != 3 or not all(marks) or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3 or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
        raise ValueError("three sentinels are needed, none of which holds or overlaps another")
    return marks


def transformed(docs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Four numbers from the SHA-256 of seed and id decide: the first two the cuts, the third whether the text changes
    (rate of 100), the fourth whether its suffix comes first (spm of 100). A text that is null (taken as empty), empty
    or holds a sentinel stays plain. Rows are independent: repeated ids and texts are transformed alike, a null id counts
    as an empty one, other columns are dropped, an empty table gives an empty result. No shuffle; besides a text and its
    output a task holds a few numbers for each byte of a block, however long the text is."""
    marks = checked(sentinels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Automaton(sentinels)
        for batch in batches:
            for part in slices(batch, 1):
                yield rearranged(part, table, marks, rate, spm)

    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    out = mapped(rows, each, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def rearranged(part: pa.RecordBatch, table: Automaton, marks: list[bytes], rate: int, spm: int) -> pa.RecordBatch:
    """A slice (id, text, digest) as its result."""
    text = part.column(1).cast(pa.large_binary())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    texts = Texts(table, data, edges)
    h = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in part.column(2).to_pylist()], np.int64).reshape(-1, 4)
    plain = (texts.n == 0) | texts.marked | (h[:, 2] % 100 >= rate)
    moved = np.flatnonzero(~plain)
    cuts = np.sort(h[moved, :2] % (texts.n[moved, None] + 1), axis=1)
    first, second = (texts.located(moved, cuts[:, k]) for k in (0, 1))
    outputs: list[object] = text.to_pylist()
    view = memoryview(data)
    pre, suf, mid = marks
    forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    for k, a, b in zip(moved, first[0], second[0], strict=True):
        head, body, tail = view[edges[k] : a], view[a:b], view[b : edges[k + 1]]
        outputs[k] = b"".join((suf, tail, pre, head, mid, body) if forms[k] == "spm" else (pre, head, suf, tail, mid, body))
    chars = np.zeros((2, len(plain)), np.int64)
    chars[0, moved], chars[1, moved] = first[1] - texts.points[moved], second[1] - first[1]
    columns = [part.column(0), pa.array(texts.n), pa.array(forms.tolist(), pa.string()), *[pa.array(c, mask=plain) for c in chars], pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transformed() made an output of, from output and form alone."""
    first, second, third = sentinels

    def between(text: Column, after: str, until: str | None) -> Column:
        start = F.position(F.lit(after), text) + len(after)
        return F.substr(text, start) if until is None else F.substr(text, start, F.position(F.lit(until), text) - start)

    psm = F.concat(between(output, first, second), between(output, third, None), between(output, second, third))
    spm = F.concat(between(output, first, third), between(output, third, None), between(output, second, first))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents cut and rearranged, as digests of the outputs and of the texts rebuilt from them."""
    out = transformed(documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
    ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM hashed
), cut AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
