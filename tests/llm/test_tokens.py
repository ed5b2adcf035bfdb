import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievery.llm.packing import Encoder, best_pattern, column_generation, cutting_stock, histogram, packed_documents, priced, token_pieces
from sievery.llm.piece_counts import PieceCounter

from .conftest import SF

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
COUNTER = PieceCounter(PIECES)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
TEXTS = st.lists(st.sampled_from(["a", "th", "the", "ing", " ", "  ", "\n", "\t", "é", "▁", "日本", "😀", "́", "aaaa", "--", "<s>", "<0x0A>", "<|endoftext|>", "\r", "\x00", "\x1c", "\xa0", "12", "'s", "!!"]) | st.text(max_size=5), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_piece_counts_are_the_librarys(text):
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text))]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    assert ENCODER.many([text])[0] == np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_runs():
    r = random.Random(3)
    pieces = [LIBRARY.id_to_piece(i).strip("▁") for i in r.sample(range(300, 31_000), 3000)]
    texts = ["a" * 20_000, "ab" * 9000, "=" * 5000, " " * 3000]
    for _ in range(150):
        texts.append("".join(r.choice(pieces) for _ in range(r.randint(10, 400))))
        texts.append("".join(r.choice("abcdeths-=aaa") for _ in range(r.randint(30, 600))))
    assert COUNTER.counts(texts) == [len(LIBRARY.encode(t)) for t in texts]


def test_a_megabyte_without_spaces_takes_seconds():
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text))]
    assert time.process_time() - began < 30


def test_documents_pack_gapless_and_whole(spark, sample):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packed_documents(docs, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for d in sample:
        want = np.array([*TOKENIZER.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want and all(p["doc_tokens"] == len(want) // 4 for p in pieces)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(r["length"] for r in rows) / (1024 * len(by_sequence)) > 0.95


def test_cutting_stock_holds_all_and_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(1, 1024, 20_000), return_counts=True)
    of = histogram(lengths, 1024)
    assert (of >= lengths).all() and len(np.unique(of)) <= 256
    bins, at = np.unique(of, return_inverse=True)
    counts = np.bincount(at, counts).astype(int)
    patterns = cutting_stock(bins, counts, 1024)
    assert (sum(n * p for n, p in patterns) == counts).all() and all(p @ bins <= 1024 for _, p in patterns)
    assert sum(n for n, _ in patterns) <= 1.01 * (bins @ counts) / 1024 + 1
    assert cutting_stock(bins[:0], counts[:0], 1024) == []


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_columns_are_generated(spark, sf):
    """On each table columns enter a plain basis, the objective falls, and it ends below the cap, close to a proven bound."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    found = sorted(pieces.groupBy("length").count().collect())
    of = histogram(np.array([r[0] for r in found]), 1024)
    bins, at = np.unique(of, return_inverse=True)
    counts = np.bincount(at, [r[1] for r in found]).astype(int)
    basis, x, report = column_generation(bins, counts, 1024)
    assert 0 < report["rounds"] < 1000 and report["pivots"] > 0
    assert report["objective"] < 0.95 * report["first"] and report["objective"] <= 1.001 * report["bound"] + 1e-6 or report["optimal"]
    assert (basis @ x >= counts - 1e-6).all() and (bins @ basis <= 1024).all() and abs(x.sum() - report["objective"]) < 1e-6
    assert sum(n for n, _ in cutting_stock(bins, counts, 1024)) <= report["objective"] + 0.005 * report["objective"] + 2


def test_small_programs_reach_the_optimum():
    """The objective equals the best of all basic solutions, found by trying every four patterns."""
    lengths, counts = np.array([3, 4, 5, 7]), np.array([20, 13, 8, 9])
    _, _, report = column_generation(lengths, counts, 16, gap=0)
    patterns = [np.array(p) for p in np.ndindex(6, 5, 4, 3) if 0 < np.dot(p, lengths) <= 16 and np.dot(p, lengths) > 13]
    columns = np.array([c for c in itertools.combinations(range(len(patterns)), 4)])
    stacks = np.array(patterns)[columns].transpose(0, 2, 1).astype(float)
    stacks = stacks[np.abs(np.linalg.det(stacks)) > 1e-9]
    x = np.linalg.solve(stacks, np.broadcast_to(counts.astype(float)[:, None], (len(stacks), 4, 1)))[..., 0]
    least = x[(x >= -1e-9).all(axis=1)].sum(axis=1).min()
    assert report["objective"] <= least + 1e-6 and report["bound"] >= report["objective"] - 1e-4


def test_pricing_is_optimal():
    lengths, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.5])
    best, took = priced(values, lengths, 16)
    brute = max(a * 2 + b * 4 + c * 5.5 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert best[16] == brute == best_pattern(took, lengths, 16) @ values
    for first in range(3):
        held = best_pattern(took, lengths, 16, first)
        assert held[first] >= 1 and held @ values == values[first] + best[16 - lengths[first]] and held @ lengths <= 16
