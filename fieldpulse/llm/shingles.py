"""Sets of five-word shingle hashes of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from fieldpulse.llm.pieces import _powers, digest_long

WIDTH = 5
#: Bytes of texts that are handled at once; a longer text is handled alone, whole.
BATCH_BYTES = 1 << 20
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte (A-Z as a-z), and which bytes are white space."""
    value = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
    value[ord("A"):ord("Z") + 1] = value[ord("a"):ord("z") + 1]
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return value, white


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _batch(texts: list[bytes]) -> list[np.ndarray]:
    value, white = _tables()
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = white[data]
    word = ~gap
    first = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(gap & np.concatenate([[False], word[:-1]]))
    power, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power)])
    words = mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    words = digest_long(words, first, last, lambda a, b: data[a:b].tobytes().lower())
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)  # words of the texts up to each
    begin = np.concatenate([[0], upto[:-1]])
    n = len(words) - WIDTH + 1
    if n > 0:
        windows = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            windows += mixed(words[k:k + n] * _STEP[k] + np.uint64(k))
        windows = mixed(windows)
    out = []
    for a, b in zip(begin.tolist(), upto.tolist()):
        if b - a >= WIDTH:
            own = np.sort(windows[a:b - WIDTH + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mixed(np.array([whole * _STEP[0] + w]))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of each text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer than five words
    make one shingle of them all, no words make none.
    """
    batch, size = [], 0
    with np.errstate(over="ignore"):
        for t in texts:
            batch.append(t.encode())
            size += len(batch[-1])
            if size >= BATCH_BYTES:
                yield from _batch(batch)
                batch, size = [], 0
        if batch:
            yield from _batch(batch)
