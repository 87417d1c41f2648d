"""XXH64 of many byte ranges at once, and the majority of bits over runs of hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges beyond this length go through the library one by one.
LONG = 1024
BLOCK = 1 << 16


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(lane + word * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for every pair of bounds, as unsigned 64-bit integers."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), BLOCK):
        part = slice(lo, lo + BLOCK)
        out[part] = _block(padded, eight, four, start[part].astype(np.int64), end[part].astype(np.int64), np.uint64(seed))
    for i in np.flatnonzero(end - start > LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i]: end[i]].tobytes(), seed=seed)
    return out


def _block(padded, eight, four, start, end, seed) -> np.ndarray:
    size = np.minimum(end - start, LONG)
    end = start + size
    h = np.full(len(start), seed + _P5 if int(seed) + int(_P5) < 1 << 64 else (int(seed) + int(_P5)) % (1 << 64), np.uint64)
    at = start.copy()
    striped = np.flatnonzero(size >= 32)
    if len(striped):
        h[striped] = _stripes(eight, start[striped], size[striped], seed)
        at[striped] += size[striped] // 32 * 32
    h += size.astype(np.uint64)
    for _ in range(3):
        go = at + 8 <= end
        word = eight[np.where(go, at, 0)]
        step = _turn(h ^ _round(np.uint64(0), word), 27) * _P1 + _P4
        h = np.where(go, step, h)
        at += go * 8
    go = at + 4 <= end
    step = _turn(h ^ (four[np.where(go, at, 0)].astype(np.uint64) * _P1), 23) * _P2 + _P3
    h = np.where(go, step, h)
    at += go * 4
    for _ in range(3):
        go = at < end
        step = _turn(h ^ (padded[np.where(go, at, 0)].astype(np.uint64) * _P5), 11) * _P1
        h = np.where(go, step, h)
        at += go
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _stripes(eight, start, size, seed) -> np.ndarray:
    top = 1 << 64
    lanes = [np.full(len(start), v % top, np.uint64) for v in (int(seed) + int(_P1) + int(_P2), int(seed) + int(_P2), int(seed), int(seed) - int(_P1))]
    stripes = size // 32
    for k in range(int(stripes.max())):
        go = stripes > k
        at = np.where(go, start + 32 * k, 0)
        for i in range(4):
            lanes[i] = np.where(go, _round(lanes[i], eight[at + 8 * i]), lanes[i])
    h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
    for lane in lanes:
        h = (h ^ _round(np.uint64(0), lane)) * _P1 + _P4
    return h


def bit_counts(hashes: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """(runs, 64) counts of set bits by position; ``run`` is ascending and names the run of each hash."""
    out = np.zeros((runs, 64), np.int64)
    if not len(hashes):
        return out
    order = np.arange(len(run))
    fresh = np.r_[True, run[1:] != run[:-1]]
    begin = np.maximum.accumulate(np.where(fresh, order, 0))
    # Eight counters of a byte each lie in one word; at most 255 hashes are added before they are spread.
    cuts = np.flatnonzero(fresh | ((order - begin) % 255 == 0))
    lanes = np.uint64(0x0101010101010101)
    of = run[cuts]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for i in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(i)) & lanes, cuts)
        counts = packed.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[of[first], i::8] = np.add.reduceat(counts, first, axis=0)
    return out


def majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """64-bit values whose bit k is set where position k was set in over half of the hashes."""
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
