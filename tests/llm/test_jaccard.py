import random
import re
from collections import Counter, defaultdict

import pytest

from fieldpulse.llm import graph, jaccard, shingles
from tests.llm import odd

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(doc_id, set size, least doc_id of the component) by comparing all pairs of different sets."""
    sets = [shingle_set(t) for _, t in docs]
    distinct = [s for s in set(sets) if s]
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for (i, _), s in zip(docs, sets):
        if s and i is not None:
            members[find(s)].append(i)
    return Counter((i, len(s), i if not s else min(members[find(s)], default=None)) for (i, _), s in zip(docs, sets))


def check(spark, docs, **change):
    df = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r)[:3] for r in jaccard.join(df).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("which", ["given", "odd"])
def test_join_matches_brute_force(spark, which):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet") if which == "given" else odd.frame(spark))


@pytest.mark.parametrize("wide,zone", [(8, 21000), (2, 6000), (1, 65535)])
def test_families_passages_and_borders(spark, monkeypatch, wide, zone):
    """Near copies of all degrees, a common passage, short texts, sizes at the border; also when the bound needs more rounds."""
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "ZONE", zone)
    rng, docs = random.Random(3), []
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    for family in range(6):
        base = words(rng.choice([12, 40, 150]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(copy[:len(copy) - rng.randrange(0, len(copy) // 4)])
    docs += [words(rng.randrange(0, 40)) + passage + words(rng.randrange(0, 40)) for _ in range(40)]
    docs += [words(rng.randrange(0, 8)) for _ in range(20)] + [["one", "same"], ["One", "SAME"], ["same", "one"]]
    base = words(104)  # 100 shingles
    docs += [base, base[:84], base[:83], base + words(25), base + words(26)]
    check(spark, [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)])


def test_shingle_sets_count_as_sets():
    texts = ["", " \t", "a", "A b", "a b c d e", "a B c d E f", "x " * 30, "é È ü 😀 ß Ä", "a\x1cb c\x0bd\x0ce f g", "w " * 200000]
    got = list(shingles.shingle_sets(texts))
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts]
    assert list(got[4]) == list(next(shingles.shingle_sets(["A b\nC d E"]))) and len({*got[4].tolist(), *got[5].tolist()}) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_empty(spark):
    assert jaccard.join(odd.none(spark)).count() == 0
