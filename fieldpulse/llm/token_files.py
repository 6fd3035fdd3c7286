"""Token-id files with a minimal perfect hash index (op 7).

Documents are dealt into ascending ranges of doc_id, each range is sorted, and
its texts are encoded into shards of about ``SHARD_IDS`` ids. A shard is one
row of a Parquet table in the shared folder: raw little-endian 32-bit ids
(``payload``) and an ``index`` in which a minimal perfect hash maps each key to
a slot. A slot holds the key's fingerprint, its first document in the shard
and how many documents have the key; ``starts`` hold where each document's ids
begin. A lookup is a hash, a bit, a rank and a fingerprint test.

The hash is built level by level: each key hashes to a place of the level's bit
array; keys alone at their place are settled, the others go on to the next
level. A key's slot is the rank of its bit.

Offsets over all shards are sums in two steps (ranges, then shards of a range).
Nothing is gathered in one task or the driver beyond a row for each range.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldpulse.llm import pieces
from fieldpulse.llm.common import shared_folder, shuffle_parts

#: A shard is closed when it has this many ids (a longer document stays whole).
SHARD_IDS = 1 << 20
END_ID = 0
#: Pieces that are encoded in one call.
JOINED = 2000
SHARDS = "part int, seq int, n_docs long, n_ids long, first long, last long, index binary, payload binary"


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: ``slots(keys)`` is a bijection onto range(n) for them."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes  # bit arrays of all levels in 64-bit words; words of each level
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        words, sizes, level = [], [], 0
        while len(keys):
            n = -(-2 * len(keys) // 64)
            place = (_mix(keys, level) % np.uint64(64 * n)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            keys, level = keys[~alone[place]], level + 1
        return cls(np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys that no level settles (never so for the keys built from)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, n in enumerate(self.sizes.tolist()):
            place = (_mix(keys[todo], level) % np.uint64(64 * n)).astype(np.int64)
            word, bit = self.first[level] + (place >> 6), (place & 63).astype(np.uint64)
            here = self.words[word]
            hit = ((here >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.rank[word] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def pack_index(keys: np.ndarray, has_key: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index of a shard whose documents (ascending keys, those without a key last) have these lengths."""
    own = keys[has_key]
    firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    distinct, many = own[firsts], np.diff(np.concatenate([firsts, [len(own)]]))
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    prints, first, count = (np.zeros(len(distinct), t) for t in ("<u4", "<u4", "<u4"))
    prints[slot], first[slot], count[slot] = _fingerprint(distinct), firsts, many
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    out = io.BytesIO()
    np.savez(out, words=table.words, sizes=table.sizes, prints=prints, first=first, count=count, starts=starts, keys=keys, has_key=has_key)
    return out.getvalue()


class Shard:
    """A shard read back: keyed access to the ids."""

    def __init__(self, index: bytes, payload: bytes):
        z = np.load(io.BytesIO(index))
        self.hash = PerfectHash(z["words"], z["sizes"])
        self.prints, self.first, self.count, self.starts = z["prints"], z["first"], z["count"], z["starts"]
        self.keys, self.has_key = z["keys"], z["has_key"]
        self.ids = np.frombuffer(payload, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first document here and how many documents have it (0: absent, by fingerprint)."""
        slot = self.hash.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == _fingerprint(keys[there])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], count[there] = self.first[slot[there]], self.count[slot[there]]
        return first, count

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.starts[i]):int(self.starts[i + 1])]


@lru_cache(maxsize=4)
def coder(path: str) -> pieces.Coder:
    """Ids of texts without added tokens (markers in a text count as ordinary characters); the tokenizers library encodes each distinct piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    line_end = ids(["\n"])[0]

    def make(new: list[str]) -> list[bytes]:
        """Many pieces in one call: a line end between two pieces that aren't white space is a piece of its own."""
        out, joined = {}, [p for p in new if p and not p.isspace()]
        for lo in range(0, len(joined), JOINED):
            own = joined[lo:lo + JOINED]
            flat = ids(["\n".join(own)])[0]
            cut = np.flatnonzero(flat == line_end[0])
            if len(line_end) == 1 and len(cut) == len(own) - 1:
                data = flat.tobytes()
                out.update((p, data[4 * a:4 * b]) for p, a, b in zip(own, [0, *(cut + 1).tolist()], [*cut.tolist(), len(flat)]))
        rest = [p for p in new if p not in out]
        out.update(zip(rest, (x.tobytes() for x in ids(rest))))
        return [out[p] for p in new]

    return pieces.Coder(make)


class WholeTexts:
    """Ids of whole texts as the library gives them: texts are cut at the tokenizer's added tokens, what lies between is coded by pieces."""

    def __init__(self, path: str):
        self.coder, self.tokenizer = coder(path), Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().items(), key=lambda x: -len(x[1].content))
        self.of = {t.content: np.array([i], "<u4") for i, t in added}
        self.marker = re.compile("(" + "|".join(map(re.escape, self.of)) + ")") if added else None
        #: Tokens that take in white space or stand as words only are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added)

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        cut = [self.marker.split(t) if self.marker and any(m in t for m in self.of) else [t] for t in texts]
        if not self.plain:
            cut = [[t] if len(c) == 1 else ["", t, ""] for t, c in zip(texts, cut)]
        between = self.coder.ids([p for parts in cut for p in parts[::2]])
        for parts in cut:
            out = [next(between)]
            for marker in parts[1::2]:
                out += [self.of[marker] if self.plain else np.array(self.tokenizer.encode(marker, add_special_tokens=False).ids, "<u4"), next(between)]
            yield out[0] if len(out) == 1 else np.concatenate(out)


@lru_cache(maxsize=4)
def whole_texts(path: str) -> WholeTexts:
    return WholeTexts(path)


def write(docs: DataFrame, folder: str, tokenizer_path: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards, ascending by doc_id (null ids last, equal ids by text)."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        known: list[bool] = []
        sizes: list[int] = []
        blobs: list[bytes] = []
        total = 0

        def closed() -> pd.DataFrame:
            k, has, n = np.array(keys, np.int64), np.array(known, bool), np.array(sizes, np.int64)
            own = k[has]
            return pd.DataFrame([{"part": part, "seq": seq, "n_docs": len(k), "n_ids": int(n.sum()),
                                  "first": int(own[0]) if len(own) else None, "last": int(own[-1]) if len(own) else None,
                                  "index": pack_index(k, has, n), "payload": b"".join(blobs)}])

        for rows in parts:
            for key, has, ids in zip(rows["key"].tolist(), rows["known"].tolist(), whole_texts(tokenizer_path).ids(rows["text"].tolist())):
                keys.append(key)
                known.append(has)
                sizes.append(len(ids) + 1)
                blobs += [ids.tobytes(), end]
                total += sizes[-1]
                if total >= shard_ids:
                    yield closed()
                    keys, known, sizes, blobs, total, seq = [], [], [], [], 0, seq + 1
        if keys:
            yield closed()

    spark = docs.sparkSession
    order = F.col("doc_id").asc_nulls_last()
    rows = (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange(4 * shuffle_parts(spark), order).sortWithinPartitions(order, "text")
            .select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "text"))
    (rows.mapInPandas(run, SHARDS).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
     .parquet(folder))


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq and the ids of all shards before it."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range of doc_ids
    before = parts.select(F.col("part").alias("_p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return shards.select("part", "seq", own.alias("own")).join(before, F.col("part") == F.col("_p")).select("part", "seq", (F.col("before") + F.col("own")).alias("shard_start"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched by its key through the index."""
    shards = spark.read.schema(SHARDS).parquet(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for r in rows.itertuples(index=False):
                s = Shard(r.index, r.payload)
                own = s.keys[s.has_key]
                first, count = s.find(own)
                if (count == 0).any():
                    raise ValueError(f"shard {r.part}/{r.seq}: the index lost a key")
                # documents with one key follow each other from its first one
                nth = np.arange(len(own)) - np.searchsorted(own, own)
                at = np.concatenate([first + nth, np.arange(len(own), len(s.keys))])
                ids = [s.document(i) for i in at]
                known = [k if h else None for k, h in zip(s.keys.tolist(), s.has_key.tolist())]
                yield pd.DataFrame({"part": r.part, "seq": r.seq, "doc_id": pd.array(known, "Int64"), "offset": s.starts[at].astype(np.int64),
                                    "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})

    got = shards.select("part", "seq", "index", "payload").mapInPandas(run, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return got.join(shard_starts(shards.select("part", "seq", "n_ids")), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """key and ids (array) of every document that has one of the distinct ``keys`` (column key); absent keys give no row.

    Keys go to the shards whose range of keys may have them, then through the index.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)
    wanted = keys.select(F.col("key").cast("long")).where("key is not null").distinct()
    routed = wanted.join(shards.select("part", "seq", "first", "last"), F.col("key").between(F.col("first"), F.col("last"))).groupBy("part", "seq").agg(F.collect_set("key").alias("keys"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for r in rows.itertuples(index=False):
                s, asked = Shard(r.index, r.payload), np.array(sorted(r.keys), np.int64)
                first, count = s.find(asked)
                # a key that isn't in the shard may share a fingerprint: its stored key tells
                found = [(k, s.document(f + j).tolist()) for k, f, c in zip(asked.tolist(), first.tolist(), count.tolist()) for j in range(c) if s.keys[f] == k]
                yield pd.DataFrame(found, columns=["key", "ids"])

    return shards.select("part", "seq", "index", "payload").join(routed, ["part", "seq"]).mapInPandas(run, "key long, ids array<long>")


def write_and_read(docs: DataFrame, tokenizer_path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files of ``docs`` to a fresh shared folder and read every document back.

    Null texts count as empty (only the end id); null doc_ids come last and are
    read by place; documents with equal ids follow each other. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    write(docs, folder, tokenizer_path, shard_ids)
    return read_back(spark, folder)
