import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from fieldpulse.llm import bpe, pieces, token_files
from tests.llm import odd

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=["given", "odd"])
def docs(request, spark):
    return spark.read.parquet(f"{SF}/documents.parquet") if request.param == "given" else odd.frame(spark)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_bpe_matches_the_library(docs, tik):
    want = Counter()
    for r in docs.collect():
        ids = tik.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, RANKS).collect()) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab '\n\t\x1c\x85  ré²½Ⅷ1_", max_size=300))
def test_bpe_on_any_text(tik, text):
    ids = next(bpe.coder(RANKS).ids([text]))
    assert ids.tolist() == tik.encode_ordinary(text) and bpe.bpe(RANKS).decimal(ids) == ",".join(map(str, ids.tolist())).encode()
    assert bpe.bpe(RANKS).decode(ids) == text.encode()


def test_bpe_long_pieces(tik):
    rng = np.random.default_rng(1)
    texts = ["a" * 5001, "ab" * 3000, "".join(rng.choice(list("etaoin"), 4000)), "é" * 700, " " * 2000, "x" * 513, "y" * 33]
    for text, ids in zip(texts, bpe.coder(RANKS).ids(texts)):
        assert ids.tolist() == tik.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab '\n\t\x1c\x85  ré²½Ⅷ1_<|endoftext|>", max_size=300))
def test_library_ids_by_pieces(tok, text):
    assert next(token_files.coder(JSON).ids([text])).tolist() == tok.encode(text, add_special_tokens=False).ids


MARKER = "<|endoftext|>"
MARKED = [MARKER, f"one{MARKER}two", f" a {MARKER}{MARKER} b\n", f"{MARKER} x", f"x \n {MARKER}", "<|endoftext|", "<|endoftext |>", f"<{MARKER}>", "no marker", ""]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([MARKER, " ", "\n", "<|", "|>", "end", "of text", "é", "it's", "12"]), max_size=12).map("".join))
def test_added_tokens_as_loaded(text):
    plain = Tokenizer.from_file(JSON)
    assert next(token_files.whole_texts(JSON).ids([text])).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files_have_added_tokens(spark):
    plain = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_files.write_and_read(docs, JSON).collect()}
    at = 0
    for i, text in enumerate(MARKED):
        ids = [*plain.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_added_tokens_that_take_in_white_space(tmp_path):
    plain = Tokenizer.from_file(JSON)
    plain.add_special_tokens([AddedToken("<|x|>", lstrip=True, rstrip=True)])
    plain.save(str(tmp_path / "own.json"))
    texts = ["a <|x|> b", "none at all", f"c{MARKER} <|x|>"]
    assert [x.tolist() for x in token_files.whole_texts(str(tmp_path / "own.json")).ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(docs, tok):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    want, start = Counter(), 0
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in token_files.write_and_read(docs, JSON, shard_ids=5000).collect()) == want


def test_lookup_by_key(spark, scratch, tok):
    rows = [(5, "five"), (5, "again five"), (9, None), (-3, "minus"), (None, "no key"), (2**60, "large")] + [(100 + i, f"text {i}") for i in range(200)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), scratch, JSON, shard_ids=50)
    got = token_files.lookup(spark, scratch, spark.createDataFrame([(5,), (9,), (-3,), (2**60,), (6,), (150,), (None,)], "key long"))
    want = Counter((k, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for k, t in rows if k in (5, 9, -3, 2**60, 150))
    assert Counter((r.key, tuple(r.ids)) for r in got.collect()) == want


def test_perfect_hash():
    keys = np.random.default_rng(0).choice(2**62, 20000, replace=False).astype(np.int64)
    table = token_files.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert 64 * len(table.words) < 6 * len(keys)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab '\n\t\x1c  relsvétmd²½Ⅷ1_\u0301", max_size=80), min_size=1, max_size=5))
def test_split_matches_the_pattern(texts):
    codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), "<u4"), np.array([pieces.STOP], "<u4"))])
    at = pieces.starts(codes)
    got = [codes[a:b] for a, b in zip(at, [*at[1:], len(codes)])]
    assert ["" if x[0] == pieces.STOP else x.tobytes().decode("utf-32-le") for x in got] == [p for t in texts for p in [*regex.findall(public_tokenizers.PATTERN, t), ""]]


def test_cache_generations_and_cut_texts(monkeypatch, tok):
    monkeypatch.setattr(pieces, "CACHE_PIECES", 5)
    monkeypatch.setattr(pieces, "BATCH_CHARS", 40)
    made = []
    coder = pieces.Coder(lambda new: made.extend(new) or token_files.coder(JSON).make(new))
    texts = ["some words that are  cut, don't you see\n\n" * 9, "", "short", "x" * 100, "again some words that are cut" * 5, ""] * 3
    assert [x.tolist() for x in coder.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(coder.young) + len(coder.old) < 40 and len(made) < 150


def test_empty_tables(spark):
    assert bpe.round_trip(odd.none(spark), RANKS).count() == 0 and token_files.write_and_read(odd.none(spark), JSON).count() == 0
