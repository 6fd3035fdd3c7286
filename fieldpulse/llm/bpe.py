"""Byte-level BPE encoding and decoding in padded numpy matrices (op 10).

Pieces of equal byte length form the rows of a matrix of token ids (lengths
beyond ``EXACT_WIDTH`` share power-of-two widths, padded). Each round every row
merges its leftmost pair of least rank: ranks of adjacent pairs come from a
hashed pair table, the winner is the row's first minimum, and the row is
compacted by one column. Only the two pairs beside a merge are looked up again.
Rows without a mergeable pair leave the matrix.

A piece longer than ``LONG_BYTES`` is a matrix of one row, in which a round
merges all occurrences of the least pair at once, unless that would bring a
pair of lower rank; then only the leftmost is merged. Both give what merging one pair
at a time gives, so a text of any length is encoded whole.

Each distinct piece of a batch is encoded once. Spark partitions the documents;
a worker holds the vocabulary, a bounded cache and one batch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm import pieces

EXACT_WIDTH = 32
LONG_BYTES = 512
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing table (left id, right id) -> rank, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(4 * len(rank)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        keys = (left.astype(np.int64) << 32) | right
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            # of several keys for one free place the last written stays; the others probe on
            self.keys[at[free]] = keys[free]
            won = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; ``NONE`` where the pair doesn't merge or either side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Bpe:
    """A vocabulary of ranks: ``encode_pieces`` and ``decode``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.numbers = [b"%d" % i for i in range(len(self.vocab))]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*np.array(pairs, np.int64).T)

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge the rows of a padded matrix (padding -1 at the end) to their final ids."""
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        row = np.arange(len(ids))
        rank = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            if not rank.shape[1]:
                done = np.ones(len(ids), bool)
            else:
                place = rank.argmin(axis=1)  # the first, i.e. leftmost, least rank
                least = rank[np.arange(len(ids)), place]
                done = least == NONE
            if done.any():
                for r, x in zip(row[done], ids[done]):
                    out[r] = x[x >= 0]
                ids, rank, row = ids[~done], rank[~done], row[~done]
                if not len(ids):
                    break
                place, least = place[~done], least[~done]
            n, width = ids.shape
            at = np.arange(n)
            ids[at, place] = least
            # compaction: close the gap that the right half of the pair leaves
            keep = np.ones((n, width), bool)
            keep[at, place + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[at, place] = False
            rank = rank[keep].reshape(n, width - 2)
            has = place > 0
            rank[at[has], place[has] - 1] = self.table(ids[at[has], place[has] - 1], ids[at[has], place[has]])
            has = place < width - 2
            rank[at[has], place[has]] = self.table(ids[at[has], place[has]], ids[at[has], place[has] + 1])
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        rank = self.table(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            # of overlapping occurrences (as in a run of one token) every other one, from the left of each run
            run = np.concatenate([[True], np.diff(at) > 1])
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            for chosen in (at, at[:1]):
                new = ids.copy()
                new[chosen] = least
                new = np.delete(new, chosen + 1)
                fresh = self.table(new[:-1], new[1:])
                if not len(fresh) or fresh.min() >= least:
                    break
            ids, rank = new, fresh
        return ids

    def encode_pieces(self, found: list[str]) -> list[np.ndarray]:
        """Final ids of each piece (none for the empty piece)."""
        data = [p.encode() for p in found]
        out: list[np.ndarray] = [None] * len(data)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            n = len(d)
            if not n:
                out[i] = np.zeros(0, np.int32)
            elif n > LONG_BYTES:
                out[i] = self._merge_long(self.of_byte[np.frombuffer(d, np.uint8)])
            else:
                buckets.setdefault(n if n <= EXACT_WIDTH else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(members), step):
                part = members[lo:lo + step]
                flat = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                ids = self.of_byte[flat]
                lengths = np.array([len(data[i]) for i in part])
                ids[np.arange(width) >= lengths[:, None]] = -1
                for i, x in zip(part, self._merge_rows(ids)):
                    out[i] = x
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(map(self.numbers.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=4)
def coder(path: str) -> pieces.Coder:
    """Ids of whole texts; each distinct piece is merged once."""
    return pieces.Coder(lambda new: [x.astype("<u4").tobytes() for x in bpe(path).encode_pieces(new)])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null texts count as empty: no ids, and the digests of nothing. Repeated
    rows each get a row; an empty table gives none.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = bpe(path)
        for part in parts:
            rows = [(len(ids), hashlib.sha256(vocabulary.decimal(ids)).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                    for ids in coder(path).ids(part["text"].tolist())]
            yield pd.concat([part["doc_id"].reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
