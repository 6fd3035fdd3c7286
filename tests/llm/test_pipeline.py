import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldpulse.llm import pii, quality
from fieldpulse.llm.common import written
from tests.llm import odd
from tests.llm.test_jaccard import brute as components
from tests.llm.test_native import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), name)
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, steps):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(d.dtypes == first.dtypes for d in steps[:-1])


def test_quality_stage(spark, steps):
    verdicts = quality.apply_rules(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in verdicts.collect() if r.kept}
    before = rows(steps[0])
    assert rows(steps[1]) == {i: r for i, r in before.items() if i in kept} and 0 < len(kept) < len(before)


def test_near_duplicate_stage(steps):
    before = rows(steps[1])
    want = {i for i, n, c in components([(i, r.text) for i, r in before.items()]) if i == c}
    assert rows(steps[2]) == {i: before[i] for i in want} and len(want) < len(before)


def test_passage_stage(steps):
    before, after = rows(steps[2]), rows(steps[3])
    texts = sorted((i, r.text.encode()) for i, r in before.items())
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            first.setdefault(t[k:k + 50], i)
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        want = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert (after[i].text, after[i].n_chars) == (want, len(want))
    assert any(after[i].text != r.text for i, r in before.items())


def test_personal_data_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_spans(steps[3]).collect()}
    changed = 0
    for i, r in before.items():
        assert {(k, a, b) for k, a, b in base_spans(r.text)} <= {(k, a, b) for a, b, k in spans[i]}
        want, at = "", 0
        for a, b, kind in sorted(spans[i]):
            if a >= at:
                want += r.text[at:a] + f"<{kind}>"
            at = max(at, b)
        want += r.text[at:]
        assert (after[i].text, after[i].n_chars, after[i].lang, after[i].source) == (want, len(want), r.lang, r.source)
        changed += want != r.text
    assert changed


def test_packing_stage_and_run(spark, steps):
    size = Counter()
    for r in steps[5].collect():
        size[r.doc_id] += r.n_tokens
    assert size == {i: len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) + 1 for i, r in rows(steps[4]).items()}
    whole = cp.run(spark, SF)
    assert whole.columns == steps[5].columns and Counter(map(tuple, whole.collect())) == Counter(map(tuple, steps[5].collect()))


def test_stages_on_odd_and_empty_tables(spark):
    docs = odd.frame(spark)
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= n
        assert stage(spark, odd.none(spark), SF).count() == 0
    masked = written(cp.personal_data(spark, docs, SF), "masked")
    assert masked.where("text is null").count() == docs.where("text is null").count()
    near = cp.near_duplicates(spark, docs, SF).where(F.length("text") > 0).groupBy("doc_id", "text").count()
    assert near.where("count > 1").isEmpty()
    assert hashlib.sha256(b"").hexdigest() == pii.digest(pii.find_spans(docs.where("text is null"))).first().base_sha256
