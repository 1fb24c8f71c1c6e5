"""Words of texts as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of text that are hashed together.
PIECE = 1 << 19
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and the number of words of each text.

    Words are runs of bytes other than 20 and 09 to 0D; A-Z count as a-z.
    """
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    size = stop - start
    letters = _LETTER[buf[inside]]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, size)
    deep = place >= 64
    power = _POWERS[place & 63]
    if deep.any():
        power[deep] = mix(place[deep].astype(np.uint64)) | np.uint64(1)
    h = mix(np.add.reduceat(letters * power, first) + size.astype(np.uint64))
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches [a, b) of the texts with about PIECE characters each."""
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= PIECE:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)
