"""Word and shingle hashes of Arrow text columns, vectorised over slices of a batch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from dossier.llm.common import mix, utf8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[_FOLD]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n."""
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and each text's first word (n + 1 offsets)."""
    data, offsets, _ = utf8(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    up, down = _powers(1 << max(20, (n - 1).bit_length()))
    total = np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    return mix((total[last] - before) * down[first] + (last - first + 1).astype(np.uint64)), np.searchsorted(first, offsets)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words; a shorter text is one shingle; none for no words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : n - width + 1 + k]
    return np.unique(mix(out))
