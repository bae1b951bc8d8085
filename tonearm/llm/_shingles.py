"""Words and word shingles of many texts at once, hashed in numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A text's shingles are
its runs of ``width`` words; a text with fewer words has one shingle, its whole word sequence; a text
without words has none.
"""

from __future__ import annotations

import numpy as np

from ._bpe import hashed_spans, mixed, text_bytes

_WS = np.zeros(256, dtype=bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each text."""
    inside = ~_WS[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(data)]
    head[cuts] = inside[cuts]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends) - 1, dtype=np.int64)
    packed = _LOWER[data[inside]]
    at = np.flatnonzero(head[inside])
    return hashed_spans(packed, at, np.diff(at, append=len(packed))), np.diff(np.searchsorted(starts, ends))


def shingles(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles, ascending."""
    words, many = word_hashes(*text_bytes(texts))
    odd = [np.uint64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64)) for j in range(width)]
    n_sh = np.where(many >= width, many - width + 1, np.minimum(many, 1))
    first, out_at = np.cumsum(many) - many, np.cumsum(n_sh) - n_sh
    flat = np.empty(int(n_sh.sum()), dtype=np.uint64)
    if len(words) >= width:
        doc = np.repeat(np.arange(len(many)), many)
        n = len(words) - width + 1
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        mix = odd[0] * words[:n]
        for j in range(1, width):
            mix += odd[j] * words[j : n + j]
        owner = doc[at]
        flat[out_at[owner] + at - first[owner]] = mixed(mix[at])
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        mix = many[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j in range(width - 1):
            has = many[short] > j
            mix[has] += odd[j] * words[first[short[has]] + j]
        flat[out_at[short]] = mixed(mix)
    out = []
    for a, n in zip(out_at.tolist(), n_sh.tolist()):
        x = np.sort(flat[a : a + n])
        out.append(x if n < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out
