"""Media columns: payloads stored as Matroska audio, and Matroska files parsed into packet tables.

A payload becomes one track of 8-bit PCM samples in clusters of laced SimpleBlocks with a cue for each cluster. The
parser reads any variable-length EBML sizes, elements of unknown size, SimpleBlocks and BlockGroups, the three kinds
of lacing and cues.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, slices

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_PLACE}

#: A packet holds up to this many bytes, a block this many packets, a cluster this many blocks; a byte is a sample, 8 a tick of a millisecond.
PACKET, LACED, BLOCKS, SAMPLES_A_MS = 1024, 8, 4, 8


def size(n: int) -> bytes:
    """n as the shortest EBML size; all ones are kept for the unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size(len(data)) + data


def number(ident: int, n: int, width: int = 0) -> bytes:
    return element(ident, n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big"))


def laced(track: int, time: int, packets: list[bytes]) -> bytes:
    """A SimpleBlock: no lacing for one packet, fixed-size lacing for equal ones, EBML lacing otherwise."""
    equal = len({len(p) for p in packets}) == 1
    lacing = 0 if len(packets) == 1 else 2 if equal else 3
    head = size(track) + struct.pack(">hB", time, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(packets) - 1])
    if lacing == 3:
        head += size(len(packets[0]))
        for a, b in zip(packets[:-2], packets[1:-1], strict=True):
            head += signed(len(b) - len(a))
    return element(SIMPLE_BLOCK, head + b"".join(packets))


def signed(n: int) -> bytes:
    """A difference of sizes in EBML lacing: biased so that it is never negative."""
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def muxed(payload: bytes) -> bytes:
    """The payload as a Matroska file of one 8-bit PCM track; equal payloads give equal files."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / SAMPLES_A_MS)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", 1000.0 * SAMPLES_A_MS)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, step = [info, tracks], [], PACKET * LACED
    place = len(info) + len(tracks)
    for at in range(0, len(payload), step * BLOCKS):
        start = at // SAMPLES_A_MS
        data = [number(CLUSTER_TIME, start)]
        for block in range(at, min(at + step * BLOCKS, len(payload)), step):
            data.append(laced(1, block // SAMPLES_A_MS - start, [payload[i : min(i + PACKET, block + step)] for i in range(block, min(block + step, len(payload)), PACKET)]))
        cluster = element(CLUSTER, b"".join(data))
        cues.append(element(CUE, number(CUE_TIME, start) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def varint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length number: its value, its width and whether all its bits are ones."""
    first = data[at] if at < len(data) else 0
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError(f"bad variable-length number at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep_marker else value), width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two places; an unknown size reaches to the end, or for a cluster to the next element that can't be its child."""
    while at < end:
        ident, width, _ = varint(data, at, keep_marker=True)
        length, more, unknown = varint(data, at + width)
        start = at + width + more
        stop = end if unknown else start + length
        if unknown and ident == CLUSTER:
            stop = start
            while stop < end:
                child, w, _ = varint(data, stop, keep_marker=True)
                if child in (CLUSTER, CUES, INFO, TRACKS):
                    break
                n, m, _ = varint(data, stop + w)
                stop += w + m + n
        if stop > end:
            raise ValueError(f"element at byte {at} ends outside its parent")
        yield ident, start, stop
        at = stop


def block_packets(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and byte ranges of the packets of a block."""
    track, width, _ = varint(data, at)
    time, flags = struct.unpack_from(">hB", data, at + width)
    at += width + 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    else:
        for k in range(n - 1):
            if lacing == 1:
                length = 0
                while data[at] == 255:
                    length, at = length + 255, at + 1
                length, at = length + data[at], at + 1
            else:
                length, width, _ = varint(data, at)
                at += width
                if k:
                    length = sizes[-1] + length - (1 << 7 * width - 1) + 1
            sizes.append(length)
    ranges = []
    for length in sizes:
        ranges.append((at, at + length))
        at += length
    if at > end:
        raise ValueError("laces are longer than their block")
    return track, time, [*ranges, (at, end)]


def parsed(data: bytes) -> dict:
    """tracks: {number: codec}; scale: nanoseconds a tick; packets: (time, track, cluster, start, end); cues: (time, track, place in the file)."""
    out: dict = {"tracks": {}, "scale": 1_000_000, "packets": [], "cues": [], "clusters": []}
    for ident, start, end in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for child, a, b in elements(data, start, end):
            if child == INFO:
                for x, c, d in elements(data, a, b):
                    if x == SCALE:
                        out["scale"] = int.from_bytes(data[c:d], "big")
            elif child == TRACKS:
                for _, c, d in elements(data, a, b):
                    fields = {x: data[e:f] for x, e, f in elements(data, c, d)}
                    out["tracks"][int.from_bytes(fields.get(NUMBER, b"\0"), "big")] = fields.get(CODEC, b"").decode()
            elif child == CLUSTER:
                base, n = 0, len(out["clusters"])
                out["clusters"].append(a)
                for x, c, d in elements(data, a, b):
                    if x == CLUSTER_TIME:
                        base = int.from_bytes(data[c:d], "big")
                        continue
                    blocks = [(c, d)] if x == SIMPLE_BLOCK else [(e, f) for y, e, f in elements(data, c, d) if y == BLOCK] if x == BLOCK_GROUP else []
                    for e, f in blocks:
                        track, time, ranges = block_packets(data, e, f)
                        out["packets"] += [(base + time, track, n, s, t) for s, t in ranges]
            elif child == CUES:
                for _, c, d in elements(data, a, b):
                    time, places = 0, []
                    for x, e, f in elements(data, c, d):
                        if x == CUE_TIME:
                            time = int.from_bytes(data[e:f], "big")
                        elif x == CUE_PLACE:
                            places.append({y: int.from_bytes(data[g:h], "big") for y, g, h in elements(data, e, f)})
                    out["cues"] += [(time, p.get(CUE_TRACK, 0), start + p.get(CUE_CLUSTER, 0)) for p in places]
    return out


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (binary): each text as UTF-8, padded with bytes 0 to a positive multiple of 64, as a Matroska file.

    A null text counts as empty. Equal texts give equal files. One pass, no shuffle; an empty table gives an empty result."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                files = [muxed(d.ljust(max(64, -(-len(d) // 64) * 64), b"\0")) for d in data]
                yield pa.record_batch([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each Matroska file: id, nth, time_ms, track, codec, cluster, start, length (bytes of the file), is_cue (the packet starts a cluster that a cue names).

    Null or damaged files give one row with nth null and the error in `error`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, columns = [], [[] for _ in range(9)]
            for r, data in enumerate(batch.column(1).to_pylist()):
                try:
                    found = parsed(data) if data else None
                    error = None if found else "no data"
                except (ValueError, IndexError, struct.error) as e:
                    found, error = None, str(e)
                lines = [(None,) * 8] if not found else []
                if found:
                    cued = {place for _, _, place in found["cues"]}
                    # a cue names the place of the cluster's id, which lies up to 12 bytes before its data
                    starts = {n for n, at in enumerate(found["clusters"]) if any(at - k in cued for k in range(5, 13))}
                    last = -1
                    for i, (time, track, cluster, a, b) in enumerate(found["packets"]):
                        lines.append((i, time * found["scale"] / 1e6, track, found["tracks"].get(track), cluster, a, b - a, cluster != last and cluster in starts))
                        last = cluster
                row += [r] * len(lines)
                for line in lines:
                    for column, value in zip(columns, (*line, error), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            names = ["id", "nth", "time_ms", "track", "codec", "cluster", "start", "length", "is_cue", "error"]
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return mapped(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, nth long, time_ms double, track long, codec string, cluster long, start long, length long, is_cue boolean, error string").withColumnRenamed("id", id_col)


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each row of text_media(), what its file holds when read back by the parser: sizes, digests, and a feature string of counts, duration and the mean and spread of the samples."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            columns = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                found = parsed(data)
                payload = b"".join([data[a:b] for _, track, _, a, b in found["packets"] if track == 1])
                samples = np.frombuffer(payload, np.uint8)
                end = found["packets"][-1][0] + (found["packets"][-1][4] - found["packets"][-1][3]) / SAMPLES_A_MS
                feature = f"packets={len(found['packets'])} clusters={len(found['clusters'])} cues={len(found['cues'])} ms={end:g} mean={samples.mean():.4f} std={samples.std():.4f}"
                for column, value in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return mapped(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(text_media(documents(spark, sf_dir)))
