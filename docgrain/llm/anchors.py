"""Anchors: a content-chosen sample of a text's positions that no long enough repeat can avoid.

The anchor of a window is the leftmost GRAM-byte string of least hash in it. Two equal windows have equal anchors at
equal places, so any `length`-byte string that occurs twice holds an anchor whose GRAM bytes occur twice.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Bytes that are searched at once; longer texts are cut into pieces that overlap by a window.
SLAB = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = 24


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; the last GRAM - 1 positions have none."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    with np.errstate(over="ignore"):
        h = word[:n] * _A
        for k in range(8, GRAM, 8):
            h ^= h >> np.uint64(29)
            h += word[k : k + n]
            h *= _B
        h ^= h >> np.uint64(32)
        h *= _A
        h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < width:
        h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
    return h


def _slab(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece number, place within it and hash of the anchors of pieces joined in data."""
    h = _gram_hashes(data)
    mask = np.uint64((1 << _PLACE) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = _least((h & ~mask) | place, length - GRAM + 1)
    # windows that lie inside one piece
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    at = (least[windows] & mask).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    piece = np.searchsorted(starts, at, side="right") - 1
    return piece, at - starts[piece], h[at]


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash (unsigned) of every anchor of the texts, in order."""
    pieces: list[tuple[int, int, int]] = []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SLAB):
            b = min(len(t), a + SLAB + length - 1)
            if b - a >= length:
                pieces.append((i, a, b))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    while k < len(pieces):
        size, stop = 0, k
        while stop < len(pieces) and (stop == k or size + pieces[stop][2] - pieces[stop][1] <= SLAB):
            size += pieces[stop][2] - pieces[stop][1]
            stop += 1
        part = pieces[k:stop]
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in part), np.uint8)
        sizes = np.array([b - a for _, a, b in part])
        stops = np.cumsum(sizes)
        piece, at, h = _slab(data, stops - sizes, stops, length)
        owner, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        out.append((owner[piece], at + offset[piece], h))
        k = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    who, at, h = (np.concatenate(x) for x in zip(*out, strict=True))
    # overlapping pieces of a long text may name an anchor twice
    new = np.ones(len(who), bool)
    order = np.lexsort((at, who))
    who, at, h = who[order], at[order], h[order]
    new[1:] = (np.diff(who) != 0) | (np.diff(at) != 0)
    return who[new], at[new], h[new]
