import glob
import os
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldpulse.llm import jaccard, suffixes
from fieldpulse.llm.common import CLEANUP, written


def met(texts):
    """Entries that go on to sorting when these texts (of ids 0, 1, ...) meet, a flush each."""
    cut = [block for i, t in enumerate(texts) for block in suffixes._cut(iter([pd.DataFrame({"id": [i], "sub": [i], "text": [t]})]), 1, 1)]
    blocks = pd.concat(cut)
    with np.errstate(over="ignore"):
        out = suffixes._meet(blocks[blocks["kind"] == 0], 1)
    return len(suffixes._read(out[out["kind"] == 2])[2])


def text(seed, n):
    return "".join(chr(97 + k) for k in np.random.default_rng(seed).integers(0, 26, n))


def test_fragments_with_a_short_string_in_common_are_not_sorted():
    # 24 bytes in common, here and there: no window of 50 bytes has company
    common = [text(900 + k, 24) for k in range(60)]
    texts = ["".join(text(1000 * i + k, 40) + c for k, c in enumerate(common)) for i in range(6)]
    assert met(texts) == 0
    # a window of 50 bytes in common is found wherever the texts differ
    for k in range(40):
        window = text(2000 + k, 50)
        assert met([text(3000 + k, 60) + window + text(4000 + k, 60), text(5000 + k, 70) + window + text(6000 + k, 50)]) >= 2


def test_shuffle_files_of_written_tables_go_at_once(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/*/shuffle_*.data"))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    out = written(spark.range(200_000).withColumn("x", F.xxhash64("id")).repartition(5, "id"), "shuffled")
    assert files() <= before
    assert out.count() == 200_000 and out.agg(F.countDistinct("x")).first()[0] == 200_000
    assert spark.conf.get(CLEANUP, "false") == (setting or "false")


def of_common_lines(n, lines, per, seed):
    """Nodes made of common lines' tokens, and of some for each two that follow each other."""
    rng = np.random.default_rng(seed)
    pool = [rng.integers(0, 1 << 62, rng.integers(5, 14)).astype(np.uint64) * np.uint64(4) for _ in range(lines)]
    edges, rows, often = {}, [], 1 / np.arange(1, lines + 1)
    for name in rng.integers(1, 1 << 62, n).tolist():
        own = rng.choice(lines, per, p=often / often.sum())
        between = [edges.setdefault(k, rng.integers(0, 1 << 62, 4).astype(np.uint64) * np.uint64(4) + np.uint64(1)) for k in zip(own, own[1:])]
        tokens = np.unique(np.concatenate([pool[k] for k in own] + between))
        rows.append((name, name, len(tokens), jaccard._binary(tokens), True))
    return rows


def test_a_token_range_of_whole_sets_keeps_few_pairs_at_once():
    rows = of_common_lines(3000, 100, 5, 4)
    with np.errstate(over="ignore"):
        blocks = next(jaccard._blocks(iter([pd.DataFrame(rows)]), 1, 1 << 64, 4096))
        blocks = blocks[blocks["part"] >= 0]
        tracemalloc.start()
        jaccard._match(blocks, 4096, True)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 150e6


def test_judged_pairs_are_those_that_miss_few_tokens():
    rows = of_common_lines(400, 12, 4, 7)
    sets = {r[0]: set(jaccard._tokens(r[3]).tolist()) for r in rows}
    with np.errstate(over="ignore"):
        blocks = next(jaccard._blocks(iter([pd.DataFrame(rows)]), 1, 1 << 64, 64))
        blocks = blocks[blocks["part"] >= 0]
        found = jaccard._match(blocks, 64, True)
        shared = pd.concat([jaccard._match(blocks, 64, True, k, 3) for k in range(3)])
    assert sorted(found.itertuples(index=False, name=None)) == sorted(shared.itertuples(index=False, name=None))
    groups = {}
    for name, own in sets.items():
        for t in own:
            groups.setdefault(t, set()).add(name)
    plain = {name: {t for t in own if len(groups[t]) <= 64} for name, own in sets.items()}
    missing = lambda n, other: int(jaccard._missing(np.array([n]), np.array([other]))[0])
    fit = lambda a, b: min(a, b) * 100 >= max(a, b) * jaccard.PERCENT
    expected, silent = set(), {q for q, own in sets.items() if len(plain[q]) <= missing(len(own), 0)}
    for q, own in sets.items():
        for g, other in sets.items():
            hits = len(plain[q] & other)
            if q != g and q not in silent and hits and fit(len(own), len(other)) and len(plain[q]) - hits <= missing(len(own), len(other)):
                expected.add((q, g, hits))
    assert {(r.q, r.g, r.hits) for r in found.itertuples() if r.hits} == expected and expected
    assert {r.q for r in found.itertuples() if r.wide} == silent and silent
