"""Quality rules with risk-controlled thresholds (op 9), DataFrame functions only.

Base rules are fixed by contract. On top of them each rule of ``RULES`` rejects
a document when its measure exceeds a cutoff. The cutoff is chosen per stratum
(language) from labelled documents: the rules of a stratum together may reject
at most a share ``alpha`` of its good documents. Each cutoff has an exact upper
bound on the share that it rejects: the least p for which k rejections among n
good ones have P(Binomial(n, p) <= k) <= delta / m, where m counts every
(stratum, rule, cutoff) that could be chosen (Bonferroni). All bounds hold at
once with probability 1 - delta, and a document is rejected by some rule at
most as often as the bounds of the chosen cutoffs add up to. Of all choices
whose sum is at most ``alpha`` the one that gains most counts; a rule that
doesn't fit in is off.

The counts come from one aggregate over all labelled documents. What reaches
the driver is that aggregate: at most strata * rules * cutoffs rows, all three
fixed lists. The chosen cutoffs return to the plan as literals, so the verdict
is a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import WHITE, shingle_hashes, words_of, written

#: Strata; every other language (or none) belongs to "other".
LANGS = ("en", "de", "fr", "es")
SYMBOLS = "#*$%&|<>"
#: Measure -> cutoffs tried; a document is rejected above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.3),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "repeat_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.19),
    "word_length": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "digit_share": (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "short_word_share": (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 0.95),
}
MEASURES = tuple(RULES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(shingles: Column) -> Column:
    """Words covered by windows found twice or more: sort (hash, place), keep those equal to a neighbour."""
    placed = F.array_sort(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return placed


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, stratum, the counts and the measures of every row of ``docs``; with ``carry`` a hash of its text as ``_row``.

    Null texts count as empty. Empty texts have all counts 0 and all measures 0.
    Windows are told apart by 64-bit hashes of their words.
    """
    text, words, sh = F.col("_text"), F.col("_words"), F.col("_sh")
    own = ["_row"] if carry else []
    rows = docs.select(*([_text_hash().alias("_row")] if carry else []), "doc_id", F.when(F.col("lang").isin(*LANGS), F.col("lang")).otherwise("other").alias("stratum"),
                       F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.select(
        *own, "doc_id", "stratum", F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("long").alias("_digits"),
        F.size(F.filter(words, lambda w: F.length(w) <= 2)).cast("long").alias("_short"),
        lines.alias("_lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("_wh"))
    rows = rows.select(
        *own, "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "_digits", "_short",
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        shingle_hashes(F.col("_wh")).alias("_sh"))
    repeated = F.size(F.array_distinct(sh)) < F.size(sh)
    rows = rows.withColumn("_placed", F.when(repeated, _repeat_words(sh)))
    placed = F.col("_placed")
    same = lambda i: F.coalesce(F.get(placed, i)["h"] == F.get(placed, i + 1)["h"], F.lit(False))
    rows = rows.withColumn("_at", F.when(placed.isNotNull(), F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: same(i) | ((i > 0) & same(i - 1))),
        lambda i: F.get(placed, i)["i"]))))
    at = F.col("_at")
    # a window covers its five words, less those that the next one covers too
    covered = F.when(at.isNotNull(), F.aggregate(
        F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"),
        lambda n, i: n + F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(5))))).otherwise(F.lit(0).cast("long"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("n_repeat_words", covered)
    return rows.select(
        *own, "doc_id", "stratum", *COUNTS,
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        share(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        share(F.col("word_chars"), F.col("n_words")).alias("word_length"),
        share(F.col("_digits"), F.col("word_chars")).alias("digit_share"),
        share(F.col("_short"), F.col("n_words")).alias("short_word_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed from the largest term down."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total, i = total + term, i - 1
    return min(total, 1.0)


def holdout_counts(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum, rule and cutoff: good and bad labelled documents, and how many of each would be rejected.

    Documents that fail the base rules are out: no cutoff decides about them.
    Labels other than 0 and 1 and null ids are ignored; a document with both
    labels counts as good.
    """
    truth = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("good")))
    held = feats.select("doc_id", "stratum", *COUNTS, *MEASURES).where(~base_failed()).join(truth, F.col("doc_id") == F.col("_id"))
    tried = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("hit"))
                      for r, cuts in RULES.items() for c in cuts])
    one = held.select("stratum", "good", F.explode(tried).alias("t"))
    return one.groupBy("stratum", "t.rule", "t.cutoff").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("n_good"),
        F.sum(F.when((F.col("good") == 1) & F.col("t.hit"), 1).otherwise(0)).alias("good_hit"),
        F.sum(F.when((F.col("good") == 0) & F.col("t.hit"), 1).otherwise(0)).alias("bad_hit"))


def upper_bound(k: int, n: int, level: float) -> float:
    """The least p (to 2**-50, from above) with P(Binomial(n, p) <= k) <= level."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (low, p) if binomial_cdf(k, n, p) <= level else (p, high)
    return high


def choose(counts: list, alpha: float, delta: float, cost: float) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff: bounds that add up to ``alpha`` at most in a stratum, and with most bad documents less ``cost`` for each good one."""
    tests = (len(LANGS) + 1) * sum(map(len, RULES.values()))
    options: dict[str, dict[str, list[tuple[float, float, float]]]] = {}
    for r in counts:
        gain = r["bad_hit"] - cost * r["good_hit"]
        if gain <= 0:
            continue
        bound = upper_bound(r["good_hit"], r["n_good"], delta / tests)
        if bound <= alpha:
            options.setdefault(r["stratum"], {}).setdefault(r["rule"], []).append((r["cutoff"], bound, gain))
    out: dict[tuple[str, str], float] = {}
    for stratum, rules in sorted(options.items()):
        best: list[tuple[float, float, dict[str, float]]] = [(0.0, 0.0, {})]  # choices so far: bound, gain and cutoffs; no other has more gain at no more bound
        for rule in MEASURES:
            tried = [(b + bound, g + gain, cuts | {rule: cutoff}) for b, g, cuts in best
                     for cutoff, bound, gain in sorted(rules.get(rule, ()), reverse=True) if b + bound <= alpha]
            # equal gains and bounds: no rule, or the higher cutoff, which rejects less
            every = sorted(best + tried, key=lambda x: (x[0], -x[1]))
            best = []
            for x in every:
                if not best or x[1] > best[-1][1]:
                    best.append(x)
        out.update({(stratum, rule): cutoff for rule, cutoff in best[-1][2].items()})
    return out


def verdict(cutoffs: dict[tuple[str, str], float]) -> Column:
    """True where no chosen cutoff rejects the row."""
    hit = F.lit(False)
    for (stratum, rule), cut in sorted(cutoffs.items()):
        hit = hit | ((F.col("stratum") == stratum) & (F.col(rule) > cut))
    return ~hit


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05,
                cost: float = 25.0) -> DataFrame:
    """Counts, base verdict and final verdict of every row of ``docs``.

    Without labels (or with too few to certify a cutoff) the base rules alone
    decide. Repeated rows and ids each get a row; an empty table gives none.
    """
    return _judged(docs, labels, alpha, delta, cost, False).select("doc_id", *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, cost: float = 25.0) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    stay = _judged(docs, labels, alpha, delta, cost, True).where("kept").select(F.col("doc_id").alias("__id"), F.col("_row").alias("__hash"))
    # the rows go in a struct, whatever their other columns are called
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), _text_hash().alias("_of"))
    return rows.join(stay, F.col("_doc").eqNullSafe(F.col("__id")) & (F.col("_of") == F.col("__hash")), "left_semi").select("_row.*")


def _judged(docs: DataFrame, labels: DataFrame, alpha: float, delta: float, cost: float, carry: bool) -> DataFrame:
    feats = written(features(docs, carry), "quality")
    cutoffs = choose(holdout_counts(feats, labels).collect(), alpha, delta, cost)
    return feats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(cutoffs))
