"""Splitting texts into the pieces that byte-level BPE merges inside, in numpy, and coding each distinct piece once.

``public_tokenizers.PATTERN`` needs four classes of characters (letters,
numbers, white space, others) and three rules, which work on whole arrays:

* a piece is a run of letters, of numbers or of others;
* a space before such a run belongs to it; other white space before a run is a
  piece of its own, and white space before that another;
* an apostrophe that begins a piece takes s, t, re, ve, m, ll or d with it.

Pieces are told apart by 64-bit hashes (a random sum over their characters, a digest of long ones).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

LETTER, NUMBER, OTHER, WHITE, END = range(5)
#: Code of the end of a text; no character has it.
STOP = 0x110000
#: Characters that are handled at once. Longer texts are cut before a space that follows a printable ASCII character.
BATCH_CHARS = 1 << 19
#: Pieces in a generation of a worker's cache.
CACHE_PIECES = 400_000
_CUT = re.compile(r"(?<=[!-~]) ")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the pattern's own library."""
    out = np.full(STOP + 1, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(STOP) if not 0xD800 <= i < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[STOP] = END
    return out


def starts(codes: np.ndarray) -> np.ndarray:
    """Places where a piece begins, in code points of texts that each end with ``STOP`` (places of STOP included)."""
    kind = _classes()[codes]
    begin = np.empty(len(codes), bool)
    begin[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == END
    # white space before a run: its last character begins a piece, and takes the run if it is a space
    run = np.flatnonzero((kind[1:] < WHITE) & (kind[:-1] == WHITE)) + 1
    begin[run - 1] = True
    begin[run[codes[run - 1] == 32]] = False
    # contractions
    mark = np.flatnonzero(codes == 39)
    if len(mark):
        before = np.where(mark > 0, codes[mark - 1], STOP)
        mark = mark[(_classes()[before] != OTHER) & (before != 32)]
        one = codes[mark + 1]  # a text ends with STOP: there is a next one
        two = np.where(one < STOP, codes[np.minimum(mark + 2, len(codes) - 1)], STOP)
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = ((is_(one, "r") | is_(one, "v")) & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        for own, n in ((mark[short], 2), (mark[long], 3)):
            begin[own + 1] = False
            begin[own + n] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=1)
def _random() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, STOP + 1, np.uint64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse (modulo 2 ** 64)."""
    if len(_POWERS[0]) < n:
        odd = 0x5851F42D4C957F2D
        for i, base in enumerate((odd, pow(odd, -1, 2**64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out)
    return _POWERS[0][:n], _POWERS[1][:n]


#: Elements up to which sums of powers modulo 2 ** 64 tell strings apart; from some 1024 on there are pairs of
#: strings with equal sums for any odd base, so longer ones have a digest of their own.
LONG = 256


def digest_long(out: np.ndarray, begin: np.ndarray, end: np.ndarray, content: Callable[[int, int], bytes]) -> np.ndarray:
    """Hashes ``out`` of the strings from ``begin`` to ``end``, those of the long ones replaced by digests of their bytes."""
    for i in np.flatnonzero(end - begin > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(content(int(begin[i]), int(end[i])), digest_size=8).digest(), "little")
    return out


def hashes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each piece that begins at ``at`` and ends where the next begins."""
    power, inverse = _powers(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_random()[codes] * power)])
    end = np.append(at[1:], len(codes))
    return digest_long((total[end] - total[at]) * inverse[at], at, end, lambda a, b: codes[a:b].tobytes())


def cut(text: str) -> Iterator[str]:
    """Parts of a text of about ``BATCH_CHARS`` that have the whole text's pieces."""
    lo = 0
    while len(text) - lo > BATCH_CHARS and (m := _CUT.search(text, lo + BATCH_CHARS)):
        yield text[lo:m.start()]
        lo = m.start()
    yield text[lo:]


class Coder:
    """Ids of whole texts, from ``make(distinct pieces) -> their ids as little-endian 32-bit bytes``.

    Two generations bound the cache of known pieces: when the young one is full
    it becomes the old one, and what is still used moves over from there.
    Results don't depend on it.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self.make, self.young, self.old = make, {}, {}

    def _known(self, keys: list[int], piece: Callable[[int], str]) -> list[bytes]:
        out = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            fresh = {}
            new = []
            for i in missing:
                old = self.old.get(keys[i])
                if old is None:
                    new.append(i)
                else:
                    fresh[keys[i]] = out[i] = old
            for i, v in zip(new, self.make([piece(i) for i in new])):
                fresh[keys[i]] = out[i] = v
            if len(self.young) + len(fresh) > CACHE_PIECES:
                self.young, self.old = fresh, self.young
            else:
                self.young.update(fresh)
        return out

    def _batch(self, parts: list[str]) -> list[np.ndarray]:
        stop = np.array([STOP], "<u4")
        codes = np.concatenate([x for p in parts for x in (np.frombuffer(p.encode("utf-32-le"), "<u4"), stop)])
        at = starts(codes)
        ends = codes[at] == STOP
        place, distinct = pd.factorize(hashes(codes, at))
        first = np.empty(len(distinct), np.int64)
        first[place[::-1]] = np.arange(len(at))[::-1]
        bound = np.append(at, len(codes))

        def piece(i: int) -> str:
            a = first[i]
            own = codes[bound[a]:bound[a + 1]]
            return "" if own[0] == STOP else own.tobytes().decode("utf-32-le")

        values = self._known(distinct.tolist(), piece)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat, where = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[place]
        total = np.cumsum(n)
        ids = flat[np.repeat(where[place] - (total - n), n) + np.arange(total[-1])]
        return np.split(ids, total[ends][:-1])

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        batch, owner, chars = [], [], 0

        def coded() -> Iterator[np.ndarray]:
            done = self._batch(batch)
            for i, ids in enumerate(done):
                open_parts.append(ids)
                if owner[i]:
                    yield open_parts[0] if len(open_parts) == 1 else np.concatenate(open_parts)
                    open_parts.clear()

        open_parts: list[np.ndarray] = []
        for t in texts:
            parts = list(cut(t))
            for i, p in enumerate(parts):
                batch.append(p)
                owner.append(i == len(parts) - 1)
                chars += len(p) + 1
                if chars >= BATCH_CHARS:
                    yield from coded()
                    batch, owner, chars = [], [], 0
        if batch:
            yield from coded()
