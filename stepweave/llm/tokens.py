"""Maximal runs of token bytes in Arrow string columns, A-Z in lower case: their places and 64-bit hashes, by vector operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import grams, mix

#: Bytes that are hashed at a time.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes between words: ASCII white space. Bytes between terms: all of ASCII but letters and digits.
BETWEEN_WORDS = np.isin(np.arange(256), [*range(9, 14), 32])
BETWEEN_TERMS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Tokens:
    """hash, start and end (bytes of data) of each token; the tokens of text t are at[t] to at[t + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    data: np.ndarray


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _INVERSE))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in lower case, offsets of each text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]], offsets - offsets[0]


def _begins(gap: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = ~gap
    out[1:] &= gap[:-1]
    out[edges] |= ~gap[edges]
    return out


def counts(texts: pa.Array, between: np.ndarray) -> np.ndarray:
    """Number of tokens of each text."""
    data, offsets = _bytes(texts)
    start = np.flatnonzero(_begins(between[data], offsets[(offsets > 0) & (offsets < len(data))]))
    return np.diff(np.searchsorted(start, offsets))


def tokens(texts: pa.Array, between: np.ndarray) -> Tokens:
    """The tokens of all texts; a null text has none."""
    data, offsets = _bytes(texts)
    gap = between[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start, stops = np.flatnonzero(_begins(gap, edges)), gap.copy()
    stops[edges] = True
    stop = np.append(np.flatnonzero(stops), len(data))
    end = stop[np.searchsorted(stop, start, "right")]
    h, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK)))
        s, e = int(start[i]), int(end[j - 1])
        power, back = _powers(1 << max(BLOCK + 4096, e - s).bit_length())
        term = (data[s:e].astype(np.uint64) + np.uint64(1)) * power[: e - s]
        term[gap[s:e]] = 0
        h[i:j] = mix(np.add.reduceat(term, start[i:j] - s) * back[start[i:j] - s])
        i = j
    return Tokens(h, start, end, np.searchsorted(start, offsets), data)


def shingles(found: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-token shingles of all texts, offsets of each text's); fewer than k tokens make one shingle, none make none."""
    counts = np.diff(found.at)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint64)
    own = np.repeat(np.arange(len(counts)), sizes)
    place = found.at[:-1][own] + np.arange(offsets[-1]) - offsets[:-1][own]
    full = counts[own] >= k
    out[full] = grams(found.hash, k)[place[full]]
    for t in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        v = np.array([counts[t]], np.uint64)
        for x in found.hash[found.at[t] : found.at[t + 1]]:
            v = v * _FOLD + x
        out[offsets[t]] = mix(v)[0]
    return out, offsets
