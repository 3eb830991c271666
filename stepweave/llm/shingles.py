"""Hashes of words and word shingles over Arrow string columns, a few vector operations for each block of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of a block; breaks: bytes at which a text begins."""
    n = len(data)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edge = breaks[(breaks > 0) & (breaks < n)]
    begins[edge] |= ~space[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    term = (data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(n, _P))
    term[space] = 0
    total = np.add.reduceat(term, starts)  # blanks up to the next word add nothing
    back = np.cumprod(np.full(n, _P_INVERSE))
    return mix(total * back[starts]), starts


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the lower-cased texts, offsets of each text's words); nulls have none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):  # end at a blank or at a text's end; one longer word stretches the block
            end = offsets[np.searchsorted(offsets, stop, "right") - 1]
            if end <= at:
                blank = np.flatnonzero(_SPACE[data[at:stop]])
                while not len(blank) and stop < len(data):
                    stop = min(stop + BLOCK, len(data))
                    blank = np.flatnonzero(_SPACE[data[at:stop]])
                end = at + blank[-1] + 1 if len(blank) else stop
            stop = int(end)
        h, s = _block_words(data[at:stop], offsets[(offsets > at) & (offsets < stop)] - at)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one run of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _Q + h[j : j + n]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, offsets of each text's); fewer than k words make one shingle, none make none."""
    h, at = words(texts)
    counts = np.diff(at)
    if len(h) < k:
        body = np.zeros(0, np.uint64)
    else:
        body = grams(h, k)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint64)
    own = np.repeat(np.arange(len(counts)), sizes)
    place = at[:-1][own] + np.arange(offsets[-1]) - offsets[:-1][own]
    full = counts[own] >= k
    out[full] = body[place[full]]
    for t in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        v = np.array([counts[t]], np.uint64)
        for x in h[at[t] : at[t + 1]]:
            v = v * _Q + x
        out[offsets[t]] = mix(v)[0]
    return out, offsets
