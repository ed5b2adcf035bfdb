"""64-bit hashes of runs of bytes (words, lines), in memory that a block bounds beyond 16 bytes a run."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
ODD = 0x9E3779B97F4A7C15
_POWER, _INVERSE = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, base, np.uint64))), dtype=np.uint64) for base in (ODD, pow(ODD, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that aren't gaps (a table of 256 booleans).

    A run's hash is a polynomial of its bytes. The bytes are read in blocks; the parts of a run that crosses a block's
    edge are joined by the power of the odd base at which the later part starts."""
    found: list[list[np.ndarray]] = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        edges = np.flatnonzero(np.diff(gap[part], prepend=True, append=True))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], dtype=np.uint64)))
        value = (sums[end] - sums[start]) * _INVERSE[start]
        start, end = start + at, end + at
        if found and found[-1][1][-1] == start[0]:
            last = found[-1]
            shift = pow(ODD, int(last[1][-1] - last[0][-1]), 1 << 64)
            last[2][-1] = np.uint64((int(last[2][-1]) + shift * int(value[0])) % (1 << 64))
            last[1][-1] = end[0]
            start, end, value = start[1:], end[1:], value[1:]
        if len(start):
            found.append([start, end, value])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, end, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    return start, end, mixed(value)
