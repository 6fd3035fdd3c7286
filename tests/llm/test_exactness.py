"""Strings that simple hashes take for equal, and columns with the operators' own names."""

import hashlib
import random
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldpulse.llm import bpe, jaccard, quality, suffixes, token_files
from tests.llm import odd

WORDS = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_with_equal_sums_of_powers_are_two(spark):
    """A Thue-Morse word and its complement, which no odd base tells apart modulo 2 ** 64."""
    rows = [(i, f"{w} w x y z v") for i, w in enumerate(WORDS)] + [(2, WORDS[0].upper() + " W x y z v")]
    frame = docs(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame).collect()}
    assert got == {0: (2, 0), 1: (2, 1), 2: (2, 0)}
    assert {r.doc_id for r in jaccard.one_of_each(frame).collect()} == {0, 1}


def test_pieces_with_equal_sums_of_powers_are_two(spark):
    frame = docs(spark, list(enumerate([w[:n] for n in (1024, 2048) for w in WORDS]))).coalesce(1)
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in bpe.round_trip(frame, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_files.write_and_read(frame, path).collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_texts_of_equal_checksum_without_ids(spark):
    """Two rows without ids whose texts have one crc32: each loses its own bytes only."""
    rng, seen = random.Random(1), {}
    shared = "".join(rng.choice("abcdefgh ") for _ in range(79))
    while True:
        tail = f" {rng.getrandbits(48):012x}"
        for text in (shared + tail, shared[::-1] + tail):
            seen.setdefault(zlib.crc32(text.encode()), set()).add(text)
        mixed = [sorted(s) for s in (seen[zlib.crc32((shared + tail).encode())], seen[zlib.crc32(text.encode())]) if len(s) > 1]
        mixed = [s for s in mixed if any(t.startswith(shared) for t in s) and any(t.startswith(shared[::-1]) for t in s)]
        if mixed:
            one, other = next(t for t in mixed[0] if t.startswith(shared)), next(t for t in mixed[0] if not t.startswith(shared))
            break
        assert len(seen) < 3_000_000
    rows = [(1, shared), (None, one), (None, other), (2**63 - 1, "z" + one)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.deduplicate(docs(spark, rows)).collect())
    assert got == sorted([(1, 79, 0), (-1, 92, 79), (-1, 92, 0), (2**63 - 1, 93, 79)])


@pytest.mark.parametrize("name", ["keep", "one_of_each", "without_repeats", "mask"])
def test_columns_with_internal_names_come_back_unchanged(spark, name):
    frame = odd.frame(spark)
    stages = {"keep": lambda d: quality.keep(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "one_of_each": jaccard.one_of_each,
              "without_repeats": suffixes.without_repeats, "mask": lambda d: corpus_pipeline.personal_data(spark, d.withColumn("n_chars", F.lit(1)), "").withColumn("n_chars", F.col("n_chars").cast("string"))}
    out = stages[name](frame)
    assert out.columns == frame.columns
    kept = out.select(*odd.INTERNAL, "payload", "_text", "_next").distinct().collect()
    assert [tuple(r) for r in kept] == [(*odd.INTERNAL, b"6", "x", "z")]


def test_ranges_withhold_no_more_than_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(2000):
        n = int(rng.integers(1, 3000))
        zone = int(rng.integers(0, n + 1))
        other = int(rng.integers(-(-n * jaccard.PERCENT // 100), n * 100 // jaccard.PERCENT + 1))
        held = rng.multinomial(zone, rng.dirichlet(np.ones(int(rng.integers(1, 40)))))
        before = np.cumsum(held) - held
        for least, missing in ((0, n - -(-n * jaccard.PERCENT // 100)), (other, n - -(-(n + other) * jaccard.PERCENT // (100 + jaccard.PERCENT)))):
            assert jaccard._missing(np.array([n]), np.array([least]))[0] == missing
            first = jaccard.prefix(np.array([zone]), np.array([missing]))[0]
            assert first == max(0, zone - missing) // 2
            kept = jaccard.withheld(first, before, held)
            assert kept.sum() == first and (kept <= held).all()
            # whatever the common tokens are, no more than the prefix stays behind
            hit = rng.integers(0, held + 1)
            assert hit.sum() - np.maximum(hit - kept, 0).sum() <= first


def test_pairs_of_single_nodes_have_one_row_and_groups_have_theirs():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2**63, 50, np.uint64)) for _ in range(3)]
    for other in sets[1:]:
        other[:45] = sets[0][:45]
        other.sort()
    nodes = [(node, comp, 50, own.astype("<u8").tobytes(), alone) for node, comp, own, alone in ((5, 5, sets[0], True), (9, 9, sets[1], True), (2, 1, sets[2], False))]
    block = next(jaccard._blocks(iter([pd.DataFrame(nodes)]), 1, 1 << 63, 8))
    found = jaccard._match(block, 8, False)
    common = lambda a, b: len(np.intersect1d(a, b))
    alike = {(9, 5): common(sets[0], sets[1]), (5, 1): common(sets[0], sets[2]), (9, 1): common(sets[1], sets[2]), (2, 5): common(sets[0], sets[2]), (2, 9): common(sets[1], sets[2])}
    # the prefix of 50 tokens: half of what is beyond 10 (any member of a group) or 6 (a set of 50) that may miss
    want = {k: v - (22 if k == (9, 5) else 20) for k, v in alike.items()}
    assert {(r.q, r.g): r.hits for r in found.itertuples() if r.hits} == want


def test_wide_counts_and_hits_reach_the_bound_whatever_the_ranges_and_blocks():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(11)
    top, limit, withheld = 1 << 63, 2, 0
    for ranges in (1, 3, 8, 20):
        base = np.sort(rng.integers(0, top, 120, np.uint64))
        common = base[:70]  # tokens that the strays have too: wide
        sets = [base]
        for _ in range(2):
            own = base.copy()
            own[rng.choice(120, 6, replace=False)] = rng.integers(0, top, 6, np.uint64)
            sets.append(np.sort(own))
        strays = [np.sort(np.concatenate([rng.choice(common, 30, replace=False), rng.integers(0, top, 90, np.uint64)])) for _ in range(9)]
        rows = [(k + 1, k + 1, 120, own.astype("<u8").tobytes(), True) for k, own in enumerate(sets + strays)]
        # in one block, and in several, where tokens are known as wide in some
        for cut in ([rows], [rows[:1] + rows[3:], rows[1:3]], [[r] for r in rows]):
            blocks = pd.concat([b for part in cut for b in jaccard._blocks(iter([pd.DataFrame(part)]), ranges, top, limit)])
            wide, hits = {}, {}
            for r in blocks[blocks.part < 0].itertuples():
                for q, n in zip(np.frombuffer(r.node, np.int64), np.frombuffer(r.size, np.int64)):
                    wide[q] = wide.get(q, 0) + n
            for _, one in blocks[blocks.part >= 0].groupby("part"):
                for r in jaccard._match(one, limit, False).itertuples():
                    (wide if r.wide else hits)[r.q if r.wide else (r.q, r.g)] = (wide if r.wide else hits).get(r.q if r.wide else (r.q, r.g), 0) + (r.wide or r.hits)
            many = pd.Series(np.concatenate(sets + strays)).value_counts()
            for q in (1, 2, 3):
                withheld += int((many[sets[q - 1]] > limit).sum()) - wide.get(q, 0)
            for q, g in ((2, 1), (3, 1), (3, 2)):
                both = len(np.intersect1d(sets[q - 1], sets[g - 1]))
                assert 100 * both >= jaccard.PERCENT * (240 - both)
                missing = jaccard._missing(np.array([120]), np.array([120]))
                first = jaccard.prefix(np.array([120]), missing)[0]
                for side in (q, g):
                    assert hits.get((q, g), 0) >= 120 - wide.get(side, 0) - missing[0] - first
    assert withheld > 0
