import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from fieldpulse.llm import fingerprints, pii, quality, sharding
from tests.llm import odd

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


@pytest.fixture(scope="module", params=["given", "odd"])
def docs(request, spark):
    return spark.read.parquet(f"{SF}/documents.parquet") if request.param == "given" else odd.frame(spark)


def test_personal_data_matches_brute_force(docs):
    want = Counter((r.doc_id, hashlib.sha256(joined(base_spans(r.text or "")).encode()).hexdigest()) for r in docs.collect())
    found = pii.digest(pii.find_spans(docs)).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in found) == want
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in found:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [(k, int(s), int(e)) for k, s, e in spans if k in pii.BASE]
        assert any(base == base_spans(t) for t in texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]


def test_personal_data_adds_supported_spans(spark):
    rows = [(i, f"my name is Maria Lopez, phone: (212) 555-01{i:02d}, version Retion Ofthe 123-45-67{i:02d}") for i in range(60)]
    rows += [(100 + i, f"mail to user{i}@mail.example.com or call +1 (509) 555-69{i % 90:02d} ok") for i in range(60)]
    got = pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in got}
    assert all("name" in kinds[i] and "local" in kinds[i] for i in range(60))
    masked = pii.find_spans(spark.createDataFrame(rows[60:61], "doc_id long, text string")).select(
        pii.masked(pii.F.lit(rows[60][1]), pii.F.col("spans")).alias("m")).first().m
    assert masked == "mail to <email> or call <phone> ok"


PAIRS = {  # a candidate that the check is for and one that it is against
    "email": ("a.b@mail.example.com", "a..b@mail.example.com"), "ip": ("10.20.30.40", "240.1.2.255"), "card": ("4111 1111 1111 1111", "9111111111111110"),
    "phone": ("+1 (509) 555-6901", "+1 (017) 555-7713"), "name": ("Maria Lopez", "At At"), "national": ("219-45-6789", "000-45-6789"),
    "account": ("DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"), "local": ("(212) 555-0101", "(017) 555-0101")}


def test_check_tells_candidates_apart(spark):
    rows = [(i, f"x: {s} .") for i, pair in enumerate(PAIRS.values()) for s in pair]
    got = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", pii.F.explode("cands").alias("c")).collect()
    votes = {}
    for r in got:
        votes.setdefault((r.doc_id, r.c.kind), []).append(r.c.check)
    for i, kind in enumerate(PAIRS):
        good, bad = votes[i, kind]
        assert good > bad, kind


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_account_check_digits(spark):
    numbers = [f"{country}{d:02d}{body}" for country, body in (("DE", "370400440532013000"), ("GB", "WEST12345698765432"), ("NO", "86011117947")) for d in range(100)]
    df = spark.createDataFrame([(x, " ".join(x[i:i + 4] for i in range(0, len(x), 4))) for x in numbers], "x string, spaced string")
    got = df.select("x", pii._mod97(df.x).alias("a"), pii._mod97(df.spaced).alias("b")).collect()
    assert all(r.a == r.b == mod97(r.x) for r in got) and sum(r.a for r in got) >= 3


def test_wrong_account_numbers_are_no_spans(spark):
    def account(i):
        body = f"3704004405{i:08d}"
        return next((f"DE{d:02d}{body}", f"DE{(d + 1) % 97 + 1:02d}{body}") for d in range(2, 99) if mod97(f"DE{d:02d}{body}"))

    rows = [(i, f"pay to account {account(i)[0]} today") for i in range(60)] + [(100 + i, f"pay to account {account(i)[1]} today") for i in range(60)]
    rows += [(200 + i, f"part {a} of the list") for i, a in ((i, account(i + 60)[1]) for i in range(60))]
    got = pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert all(("account" in r.spans) == (r.doc_id < 100) for r in got)


def test_em_finds_the_unreliable_labeler():
    # votes of labeler 0 follow the truth, those of labeler 4 are noise
    patterns = [("name", (1, 1, 0, 1, -1), 400), ("name", (1, 1, 0, 1, 1), 400), ("name", (-1, -1, 0, 1, 1), 400), ("name", (-1, -1, 0, 1, -1), 400)]
    post = pii.estimate(patterns)
    assert post["name", (1, 1, 0, 1, -1)] > 0.9 > 0.1 > post["name", (-1, -1, 0, 1, 1)]
    bias, weights = pii.train(patterns, post)
    assert weights[0] > 5 * abs(weights[4])


def counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    shingles = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(shingles), set()
    for i, s in enumerate(shingles):
        if seen[s] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = Counter()
    for r in docs.collect():
        c = counts(r.text or "")
        want[(r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    got = quality.apply_rules(docs, labels).collect()
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_cutoffs_are_certified(spark):
    prose = "the plain words of a clean text go on and on " * 3
    docs = [(i, f"{prose} {i}", "en") for i in range(700)] + [(1000 + i, "junk### more$$$ of&&& it%%% " * 5 + f"n{i} x y z a b c d e", "en") for i in range(50)]
    docs = [(i, " ".join(f"{w}{i}" if k % 4 == 0 else w for k, w in enumerate(t.split())) + " " + " ".join(f"q{i}w{k}" for k in range(200)), lang) for i, t, lang in docs]
    docs = [(i, t if i < 1000 else t.replace(" q", " #$q"), lang) for i, t, lang in docs]
    labels = [(i, int(i < 1000), 0) for i, _, _ in docs] + [(None, 1, 0), (3, None, None)]
    got = quality.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in got.collect() if not r.base_failed}
    assert all(kept[i] for i in kept if i < 1000) and not any(kept[i] for i in kept if i >= 1000)


def test_binomial_bound():
    from math import comb
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.02), (400, 9, 0.05), (5, 5, 0.1)):
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    # too few labels certify nothing
    few = [{"stratum": "en", "rule": "symbol_share", "cutoff": 0.1, "n_good": 20, "good_hit": 0, "bad_hit": 9}]
    assert quality.choose(few, 0.02, 0.05, 25.0) == {}


def test_rules_of_a_stratum_share_the_risk():
    level = 0.05 / (5 * sum(map(len, quality.RULES.values())))

    def counts(n, k):
        return [{"stratum": "en", "rule": r, "cutoff": cuts[c], "n_good": n, "good_hit": k * (2 - c), "bad_hit": 1000 - 100 * i - c}
                for i, (r, cuts) in enumerate(quality.RULES.items()) for c in (1, 2)]

    for n, k, rules in ((700, 0, 1), (1000, 0, 2), (3000, 0, 6), (3000, 3, 6), (2000, 4, 4), (100, 0, 0)):
        got = quality.choose(counts(n, k), 0.02, 0.05, 1.0)
        hits = {(c["rule"], c["cutoff"]): c["good_hit"] for c in counts(n, k)}
        bounds = [quality.upper_bound(hits[rule, cut], n, level) for (_, rule), cut in got.items()]
        assert sum(bounds) <= 0.02 and len(got) == rules
        assert [r for _, r in got] == list(quality.RULES)[:rules]  # those that gain most
        for b, (key, cut) in zip(bounds, got.items()):
            assert quality.binomial_cdf(hits[key[1], cut], n, b) <= level < quality.binomial_cdf(hits[key[1], cut], n, b * 0.999)


def test_shards(docs):
    got = sharding.assign(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_confine_moves(spark):
    keys = spark.range(24000)
    rows = keys.select(*[sharding.shard_of(keys.id, n).alias(f"s{n}") for n in (24, 25, 26)]).collect()
    sizes = Counter(r.s24 for r in rows)
    assert len(sizes) == 24 and all(850 < n < 1150 for n in sizes.values())
    assert all(r.s25 in (r.s24, 24) and r.s26 in (r.s25, 25) for r in rows)
    assert 800 < sum(r.s25 == 24 for r in rows) < 1120


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_fingerprints(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in rows]
    want = Counter()
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[:len(t) - q] + texts[(i + 1) % len(texts)][:q]
        want[rows[i].doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprints.compare_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    ids = Counter(r.doc_id for r in rows)
    for r in rows:
        if ids[r.doc_id] == 1:
            by_text.setdefault(r.text or "", set()).update(g.fingerprint for g in got if g.doc_id == r.doc_id)
    assert all(len(v) == 1 for v in by_text.values())


def sketch(text):
    """Retained hashes and, where there are none, the least: 64-bit hashes of five words, each seeded by those before."""
    def hashed(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (h >> 63 << 64)

    w = WORD.findall(text)
    every = {hashed(*w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {hashed("short", " ".join(w))} if w else set()
    kept = frozenset(h for h in every if 0 <= h < 2 ** (64 - fingerprints.SCALE_BITS))
    return kept, min(every) if every and not kept else None


def test_fingerprints_and_likeness_match_brute_force(spark):
    def alike(a, b):
        (x, least), (y, other) = sketch(a), sketch(b)
        return len(x & y) / len(x | y) if x | y else float(least == other)

    def shown(text):
        kept, least = sketch(text)
        return ".".join(f"{h:x}" for h in sorted(kept)) if least is None else f"~{least % 2**64:x}"

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    top = max(i for i, _ in rows)
    rows += [(top + 1 + i, t) for i, t in enumerate(["", None, "one", "One two", "a b c d e", "a b c d e f", "a b c d e f", " \t ", "é ü ß 😀 Ä ö"])]
    rows = sorted(rows)
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        t, beside, q, r = texts[i], texts[(i + 1) % len(texts)], len(texts[i]) // 4, got[doc_id]
        edited = t[:len(t) - q] + beside[:q]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(t), shown(edited))
        assert r.near_edited == pytest.approx(alike(t, edited)) and r.near_next == pytest.approx(alike(t, beside))


def test_short_texts_are_told_apart_by_degrees(spark):
    """Twenty to thirty words: the mean error against the true likeness of the shingles."""
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 30))]
        k = rng.randrange(len(a))
        pairs.append((" ".join(a), " ".join(a[:k] + [f"x{rng.randrange(10**6)}" for _ in a[k:]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
    error = [abs(r.j - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b))) for r in df.select("a", "b", fingerprints.likeness(df.sa, df.sb).alias("j")).collect()]
    assert sum(error) / len(error) < 0.08


def test_likeness_estimates_the_true_similarity(spark):
    words = [f"w{i}" for i in range(4000)]
    pairs = [(" ".join(words), " ".join(words[:3000]) + " " + " ".join(f"x{i}" for i in range(1000))), (" ".join(words), " ".join(words[1000:1500]))]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
    got = df.select(fingerprints.likeness(df.sa, df.sb).alias("j"), fingerprints.containment(df.sb, df.sa).alias("c"), fingerprints.merge(df.sa, df.sb).alias("m"), "sa", "sb").collect()
    for r, (a, b) in zip(got, pairs):
        x, y = shingles(a), shingles(b)
        assert r.j == pytest.approx(len(x & y) / len(x | y), abs=0.08)
        assert r.c == pytest.approx(len(x & y) / len(y), abs=0.1)
        assert r.m == sorted({*r.sa.kept, *r.sb.kept})


def test_empty_tables(spark):
    docs, labels = odd.none(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (pii.digest(pii.find_spans(docs)), quality.apply_rules(docs, labels), sharding.assign(docs), fingerprints.compare_edits(docs)):
        assert out.count() == 0
