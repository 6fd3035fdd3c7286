"""Phrase collocations by stripes (op 13).

A stripe belongs to a prefix (a phrase of none to four words, of one language) and
counts the words that follow it, in an associative counter (two lists in step).
Tasks make stripes from their texts, as many as they hold at once, and stripes of a
prefix are merged word by word. Everything else comes from the merged stripes:

* f(phrase) is the entry of its last word; so the entries also are the totals of
  the prefixes with one word more. The total of the empty prefix, the number of all
  words, stands under the empty word;
* the largest entry of a stripe is the most frequent phrase that goes on from the
  prefix; read by the prefix's words from the second on, the entries give those
  that add a word in front. A phrase inside a longer one that is as frequent is
  inside such a one with one word more, which is a candidate itself.

Three passes: the stripe of the empty prefix, those of words, those of phrases of
two to four words. As a phrase is no more frequent than its parts, the second pass
takes frequent words only, the third phrases whose pairs of words are all frequent.
What is frequent travels as a bitmap of at most ``MOST_BITS``; a false hit costs
some counting, and its count is exact like all others.

Stripes of very frequent prefixes (at most ``1 / HOT`` of them) are cut into
``SEGMENTS`` by the following word, so that none of them meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldpulse.llm.common import discard, written
from fieldpulse.llm.shingles import mixed

LONGEST, LEAST, BEST = 5, 100, 2000
#: Bytes of text that are counted at once; a longer text is counted alone, whole.
BATCH_BYTES = 8 << 20
MOST_BITS, LEAST_BITS = 1 << 27, 1 << 16
#: Bytes of the bitmap that one task makes.
PIECE = 1 << 16
HOT, SEGMENTS = 1 / 1000, 64
STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("seg", pa.int32()), ("next", pa.string()), ("n", pa.list_(pa.int32()))])
#: ``next`` has the words that follow, with a space between; ``n`` their counts.
STRIPE_SQL = "lang string, prefix string, seg int, next string, n array<int>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _END.copy()
_GAP[[ord(" "), ord("\t")]] = True
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _step(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mixed(total * _MUL[0] + word * _MUL[1] + np.uint64(1))


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


class Sieve:
    """Which phrases may be frequent: a bitmap over hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve(phrases: DataFrame) -> Sieve:
    """The bitmap of the rows (lang, phrase)."""
    size = LEAST_BITS
    many = phrases.count()
    while size < min(MOST_BITS, 16 * many):
        size *= 2

    def places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            total = _hashes(part["lang"].to_numpy())
            words = [p.split(" ") for p in part["phrase"]]
            with np.errstate(over="ignore"):
                for k in range(max(map(len, words), default=0)):
                    own = np.array([i for i, w in enumerate(words) if len(w) > k])
                    total[own] = _step(total[own], _hashes(np.array([words[i][k] for i in own], object)))
            at = (total & np.uint64(size - 1)).astype(np.int64)
            yield pd.DataFrame({"piece": at // (8 * PIECE), "at": at % (8 * PIECE)})

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(min(PIECE, size // 8), np.uint8)
        at = rows["at"].to_numpy()
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [bits.tobytes()]})

    made = phrases.select("lang", "phrase").mapInPandas(places, "piece long, at long").distinct().groupBy("piece").applyInPandas(piece, "piece long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in made.collect():  # size / 8 bytes at most
        own = np.frombuffer(row["bits"], np.uint8)
        bits[row["piece"] * PIECE:][:len(own)] = own
    return Sieve(bits)


class _Words:
    """The words of some texts: distinct ones, and for each place its word, language and piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]] if values is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        gap = _GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = ~gap
        first = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], gap[:-1]])[:len(gap)]))
        last = np.flatnonzero(word & (edge[1:] | np.concatenate([gap[1:], [True]])[:len(gap)]))
        packed = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
        every = pa.StringArray.from_buffers(len(first), pa.py_buffer(packed.tobytes()), pa.py_buffer(_LOWER[data[word]].tobytes())).dictionary_encode()
        self.word = every.indices.to_numpy().astype(np.int64)
        self.words = every.dictionary
        document = np.searchsorted(offsets, first, "right") - 1
        known = langs.dictionary_encode()
        self.langs = known.dictionary
        self.lang = known.indices.to_numpy().astype(np.int64)[document]
        piece = np.searchsorted(np.flatnonzero(_END[data]), first)
        self.joined = np.zeros(len(first), bool)  # to the word after it
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (document[1:] == document[:-1])
        self.hash = _hashes(self.words.to_numpy(zero_copy_only=False))
        self.lang_hash = _hashes(self.langs.to_numpy(zero_copy_only=False))

    def single(self) -> np.ndarray:
        """Hash of each place's phrase of one word."""
        return _step(self.lang_hash[self.lang], self.hash[self.word])


def _counted(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns of codes, in order, and how often each occurs."""
    bits = [max(1, int(s - 1).bit_length()) for s in sizes]
    if sum(bits) < 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c, b in zip(columns, bits):
            key = (key << b) | c
        key, many = np.unique(key, return_counts=True)
        out = []
        for b in reversed(bits):
            out.append(key & ((1 << b) - 1))
            key = key >> b
        return out[::-1], many
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in sorted_:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in sorted_], np.diff(np.append(at, len(order)))


def _joined(words: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    """Phrases of these words."""
    return pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in codes], " ")


def _rows(words: _Words, columns: list[np.ndarray], many: np.ndarray, hot: set) -> pa.RecordBatch:
    """Stripes from distinct (language, prefix words ..., next word or -1 for the total) in order with their counts."""
    lang, prefix, nxt = columns[0], columns[1:-1], columns[-1]
    new = np.zeros(len(many), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    at, owner = np.flatnonzero(new), np.cumsum(new) - 1
    langs = words.langs.take(pa.array(lang[at]))
    names = _joined(words.words, [c[at] for c in prefix]) if prefix else pa.array([""] * len(at), pa.string())
    heads = _joined(words.words, [c[at] for c in prefix[:2]]) if len(prefix) > 2 else names
    cut = pc.is_in(pc.binary_join_element_wise(langs, heads, "\n"), pa.array(sorted(hot), pa.string())).to_numpy(zero_copy_only=False).astype(bool)
    seg = np.where(cut[owner] & (nxt >= 0), words.hash[np.maximum(nxt, 0)] % np.uint64(SEGMENTS), 0).astype(np.int32) if len(many) else np.zeros(0, np.int32)
    order = np.lexsort((seg, owner))
    seg, owner, nxt, many = seg[order], owner[order], nxt[order], many[order]
    new = np.zeros(len(many), bool)
    new[:1] = True
    new[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
    at = np.flatnonzero(new)
    offsets = pa.array(np.append(at, len(many)).astype(np.int32))
    entries = words.words.take(pa.array(nxt, mask=nxt < 0)).fill_null("")
    own = pa.array(owner[at])
    return pa.RecordBatch.from_arrays([langs.take(own), names.take(own), pa.array(seg[at]),
                                       pc.binary_join(pa.ListArray.from_arrays(offsets, entries), " "), pa.ListArray.from_arrays(offsets, pa.array(many.astype(np.int32)))], schema=STRIPE)


def _words_stripes(words: _Words) -> pa.RecordBatch:
    """The stripe of the empty prefix of each language."""
    (lang, word), many = _counted([words.lang, words.word], [len(words.langs), len(words.words)])
    total = np.bincount(words.lang, minlength=len(words.langs)) if len(words.lang) else np.zeros(len(words.langs), np.int64)
    used = np.flatnonzero(total)
    lang, word, many = np.concatenate([lang, used]), np.concatenate([word, np.full(len(used), -1)]), np.concatenate([many, total[used]])
    order = np.lexsort((word, lang))
    return _rows(words, [lang[order], word[order]], many[order], {f"{x}\n" for x in words.langs.to_pylist()})


def _phrase_stripes(words: _Words, prefix: int, at: np.ndarray, hot: set) -> pa.RecordBatch:
    """Stripes of the phrases of ``prefix`` words that begin at ``at`` and go on with the next word."""
    own, many = _counted([words.lang[at], *[words.word[at + k] for k in range(prefix + 1)]], [len(words.langs), *[len(words.words)] * (prefix + 1)])
    return _rows(words, own, many, hot)


def stripes(docs: DataFrame, words_in: Sieve | None = None, pairs_in: Sieve | None = None, hot: set = frozenset()) -> DataFrame:
    """Stripes of (lang, text) rows, task by task: of the empty prefix; of words in ``words_in``; or of longer prefixes from ``pairs_in``."""
    def made(texts: pa.Array, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        words = _Words(texts, langs)
        if not len(words.word):
            return
        if words_in is None and pairs_in is None:
            yield _words_stripes(words)
            return
        single = words.single()
        if pairs_in is None:
            known = words_in.has(single)
            on = words.joined.copy()
            on[:-1] &= known[1:]
            yield _phrase_stripes(words, 1, np.flatnonzero(known & on), hot)
            return
        pair = words.joined.copy()
        i = np.flatnonzero(pair)
        pair[i] = pairs_in.has(_step(single[i], words.hash[words.word[i + 1]]))
        held = pair  # phrases of k + 1 words whose pairs are all known
        for k in range(2, LONGEST):
            longer = held.copy()
            longer[:-(k - 1)] &= pair[k - 1:]
            longer[len(longer) - (k - 1):] = False
            at = np.flatnonzero(longer)
            if not len(at):
                return
            yield _phrase_stripes(words, k, at, hot)
            held = longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(1), batch.column(0)
            size = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64))) if len(texts) else np.zeros(0)
            begin = 0
            while begin < len(texts):
                done = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, done + BATCH_BYTES, "right")))
                with np.errstate(over="ignore"):
                    yield from made(texts.slice(begin, end - begin), langs.slice(begin, end - begin))
                begin = end

    return docs.select("lang", "text").mapInArrow(run, STRIPE_SQL)


def merged(parts: DataFrame) -> DataFrame:
    """(lang, prefix, next, f): stripes added up word by word; frequent entries and the total of the empty prefix stay."""
    entry = F.arrays_zip(F.split("next", " ", -1).alias("next"), F.col("n"))
    flat = parts.repartition("lang", "prefix", "seg").select("lang", "prefix", "seg", F.explode(entry).alias("e")).select("lang", "prefix", "seg", F.col("e.next").alias("next"), F.col("e.n").cast("long").alias("n"))
    return flat.groupBy("lang", "prefix", "seg", "next").agg(F.sum("n").alias("f")).where((F.col("f") >= LEAST) | (F.col("next") == "")).drop("seg")


def _hot(phrases: DataFrame, total: int) -> set:
    """Language and phrase of the most frequent phrases: at most 1 / HOT."""
    return {f"{r['lang']}\n{r['phrase']}" for r in phrases.where(F.col("f") >= max(LEAST, total * HOT)).select("lang", "phrase").collect()}


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Null texts are empty, a null lang is ``und``. Rows are counted one by one, repeated ones too. Texts
    and tables without words give no rows. doc_id takes no part.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(merged(stripes(texts)), "stripes")
    sizes = words.where("prefix = '' and next = ''").select("lang", F.col("f").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase")
    frequent = words.where("next <> ''").select("lang", phrase, "f")
    pairs = written(merged(stripes(texts, words_in=sieve(frequent), hot=_hot(frequent, total))), "stripes")
    frequent = pairs.select("lang", phrase, "f")
    longer = written(merged(stripes(texts, pairs_in=sieve(frequent), hot=_hot(frequent, total))), "stripes")

    entries = pairs.unionByName(longer).select("lang", "prefix", phrase, F.col("f").alias("a"))
    totals = words.where("next <> ''").select("lang", phrase, "f").unionByName(entries.select("lang", "phrase", F.col("a").alias("f")))
    ahead = entries.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("m"))
    behind = entries.groupBy("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase")).agg(F.max("a").alias("m"))
    inside = ahead.unionByName(behind).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = entries.join(inside, ["lang", "phrase"], "left").where("m is null or 100 * m < 100 * a").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, f: totals.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes.withColumnRenamed("size", "n"), "lang")
    exact = lambda x, y: f"CAST({x} AS DECIMAL(19,0)) * CAST({y} AS DECIMAL(19,0))"
    score = F.expr(f"({exact('1000 * a', 'n')}) div ({exact('l', 'r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", best).where(F.col("rank") <= BEST)
    out = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(words, pairs, longer)
    return out


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM words)" for k in range(1, LONGEST + 1))}),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand d WHERE d.lang = c.lang AND len(d.w) > len(c.w) AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n, ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM kept) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN sizes s ON s.lang = c.lang),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least) WHERE rank <= {BEST}
"""
