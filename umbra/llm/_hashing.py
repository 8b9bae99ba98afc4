"""Hashes of the words of a text, computed by array for whole buffers."""

from __future__ import annotations

import numpy as np

#: Bytes of a buffer that are hashed together; longer texts are cut at gaps between words.
BUFFER = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, 5, dtype=np.uint64)
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: bytes) -> np.ndarray:
    """Hashes of the words of one buffer: sums over a word's bytes of a value that depends on byte and place in a way
    that is no polynomial, so that no arrangement of the same bytes is bound to collide."""
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _GAP[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    sizes = edge[1::2] - edge[::2]
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    x = (np.arange(int(sizes.sum())) - np.repeat(first, sizes)).astype(np.uint64)
    x *= _STEP
    x += _BYTE[b[~gap[1:-1]]]
    x ^= x >> np.uint64(29)
    x *= _SPREAD
    x ^= x >> np.uint64(32)
    return mix(np.add.reduceat(x, first) + sizes.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """uint64 hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case."""
    data = text.encode().translate(_LOWER)
    if len(data) <= BUFFER:
        return _words(data)
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + BUFFER)
        while to < len(data) and not _GAP[data[to]]:
            to += 1
        found.append(_words(data[at:to]))
        at = to
    return np.concatenate(found)


def many_word_hashes(texts: list[str]) -> list[np.ndarray]:
    """word_hashes of each text; small texts share a buffer."""
    out: list[np.ndarray] = []
    group: list[str] = []
    size = 0

    def flush():
        nonlocal size
        if not group:
            return
        datas = [t.encode().translate(_LOWER) for t in group]
        joined = b" ".join(datas)
        b = np.frombuffer(joined, np.uint8)
        gap = np.concatenate([[True], _GAP[b]])
        starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        bounds = np.cumsum([len(d) + 1 for d in datas])
        out.extend(np.split(_words(joined), np.searchsorted(starts, bounds[:-1])))
        group.clear()
        size = 0

    for t in texts:
        if len(t) > BUFFER // 4:
            flush()
            out.append(word_hashes(t))
        else:
            group.append(t)
            size += len(t)
            if size > BUFFER // 4:
                flush()
    flush()
    return out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word n-grams; with fewer words the whole sequence is one; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < size:
            return mix((words * _PLACE[:n]).sum(dtype=np.uint64)[None] + _SHORT[n])
        total = words[: n - size + 1] * _PLACE[0]
        for k in range(1, size):
            total = total + words[k : n - size + 1 + k] * _PLACE[k]
        return np.unique(mix(total))
