import hashlib
import random
import struct
import zlib

import pytest

from sievery.llm import matroska as mk

from .conftest import SF


@pytest.mark.parametrize("n", [64, 1024, 1088, 8192, 8256, 32_768, 32_832, 200_000 // 64 * 64])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = mk.muxed(payload)
    found = mk.parsed(data)
    assert b"".join(data[a:b] for *_, a, b in found["packets"]) == payload
    assert [data[p : p + 4] for _, _, p in found["cues"]] == [mk.CLUSTER.to_bytes(4, "big")] * len(found["clusters"])
    times = [p[0] for p in found["packets"]]
    assert times == sorted(times) and found["tracks"] == {1: "A_PCM/INT/LIT"}


def block(lacing, sizes):
    packets = [bytes([i]) * n for i, n in enumerate(sizes)]
    head = mk.size(1) + struct.pack(">hB", 5, lacing << 1) + bytes([len(sizes) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    return head + b"".join(packets), packets


def test_xiph_lacing_in_a_block_group_of_a_cluster_of_unknown_size():
    data, packets = block(1, [300, 255, 7, 40])
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.number(mk.CLUSTER_TIME, 100) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, data))
    found = mk.parsed(mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, cluster + mk.element(mk.CUES, b"")))
    assert [found_packet[0] for found_packet in found["packets"]] == [105] * 4
    whole = mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, cluster + mk.element(mk.CUES, b""))
    assert [whole[a:b] for *_, a, b in found["packets"]] == packets


def test_damaged_files_are_named(spark):
    good = mk.muxed(b"x" * 64)
    rows = spark.createDataFrame([(1, good), (2, good[:-9]), (3, None), (4, b"")], "doc_id long, media binary")
    found = {r["doc_id"]: r for r in mk.packets(rows).collect()}
    assert found[1]["is_cue"] and found[1]["length"] == 64 and found[1]["error"] is None
    assert found[2]["error"] and found[3]["error"] == found[4]["error"] == "no data"


def test_digest_is_the_texts(spark, sample):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in mk.media_digest(mk.text_media(docs)).collect()}
    for d in sample:
        raw = d["text"].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
