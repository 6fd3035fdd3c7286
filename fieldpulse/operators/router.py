"""Rule-based question routing over tables of questions (T-01, T-02, T-03, T-13).

The reference routes one string at a time; here the rules are Column
expressions over a whole column of questions: an ordered ``when`` chain of
``rlike`` tests (first match wins, evaluation stops at the first hit), then
the table inference as ``contains`` tests, then the default route for
questions no rule matches. Map-only: no shuffle, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.parallel import spread
from fieldpulse.functions.regex import SPACE_CHARS, portable, prefilter

# ---------------------------------------------------------------------------
# The reference's keyword rules, in rule order and pattern order
# (route, patterns, fixed tables or None = infer from the question).
# ---------------------------------------------------------------------------
KEYWORD_RULES = (
    ("precomputed", (
        r"\b(executive|brief|rangkum|rangkuman|snapshot|overview)\b",
        r"\b(kondisi\s+terkini|status\s+keseluruhan|situasi\s+terkini)\b",
        r"\b(rekomendasi\s+(?:umum|keseluruhan|strategis))\b",
    ), "both"),
    ("quantitative", (
        r"\b(berapa|total|jumlah|hitung|count)\b",
        r"\b(daftar|list|sebutkan|tampilkan)\b",
        r"\b(tertinggi|terendah|terbesar|terkecil|top\s*\d+|ranking)\b",
        r"\b(rata-rata|average|persentase|persen)\b",
        r"\b(bandingkan|perbandingan|compare|vs)\b",
        r"\b(per\s+(?:region|wilayah|holding|tipe))\b",
        r"\b(breakdown|rincian|distribusi)\b",
        r"\b(progress.+rendah|potensi.+besar|belum.+mulai)\b",
        r"\b(status\s+pelaksanaan)\b",
    ), None),
    ("qualitative", (
        r"\b(kenapa|mengapa|alasan)\b",
        r"\b(jelaskan|ceritakan|deskripsikan)\b",
        r"\b(apa\s+(?:kendala|masalah|hambatan|objektif|outlook))\b",
    ), None),
)

# Table-inference keywords (plain substrings, not words).
SURVEY_KEYWORDS = (
    "survei", "survey", "seismik", "seismic", "recording", "receiver",
    "shot point", "onshore", "offshore", "fold", "offset", "afe",
    "mmboe", "resource", "prospect", "lead", "play",
)
STUDY_KEYWORDS = (
    "studi", "study", "reprocessing", "g&g", "lab", "analisis",
    "mnk", "vendor", "validator",
)

# Table labels, default route, valid routes.
BOTH, SURVEY_TABLE, STUDY_TABLE = "both", "survey_main", "study_main"
DEFAULT_ROUTE = "quantitative"
VALID_ROUTES = ("quantitative", "qualitative", "precomputed", "composite")


def _any_contains(text: Column, words: tuple[str, ...]) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def infer_tables(question: Column) -> Column:
    """T-02: which tables a question is about (substring match, so ``lab`` hits ``label``)."""
    q = F.lower(question)
    survey, study = _any_contains(q, SURVEY_KEYWORDS), _any_contains(q, STUDY_KEYWORDS)
    return (F.when(survey & study, F.lit(BOTH)).when(study, F.lit(STUDY_TABLE))
            .when(survey, F.lit(SURVEY_TABLE)).otherwise(F.lit(BOTH)))


ANY_RULE = "|".join(f"(?:{portable(p)})" for _, patterns, _ in KEYWORD_RULES for p in patterns)


def keyword_match(question: Column) -> Column:
    """T-01: struct(route, pattern, fixed_tables) of the first matching rule, or NULL.

    Every alternative of every rule starts with a literal word, so a question
    that contains none of those words cannot match: that cheap ``contains``
    gate skips the regex chain for most text; the ordered chain then names
    the first matching rule.
    """
    q = F.lower(question)
    out = None
    for route, patterns, tables in KEYWORD_RULES:
        for p in patterns:
            hit = F.struct(F.lit(route).alias("route"), F.lit(p).alias("pattern"),
                           F.lit(tables).cast("string").alias("fixed_tables"))
            cond = q.rlike(portable(p))
            out = F.when(cond, hit) if out is None else out.when(cond, hit)
    gate = prefilter(q, [p for _, ps, _ in KEYWORD_RULES for p in ps])
    return F.when(q.rlike(ANY_RULE) if gate is None else gate, out)


def route_questions(df: DataFrame, question_col: str = "question",
                    default_route: str = DEFAULT_ROUTE) -> DataFrame:
    """T-01 + T-02 + T-03 over a DataFrame of questions.

    Adds ``route``, ``tables``, ``matched_pattern``, ``intent`` and ``method``
    (``keyword`` or ``fallback``). Unmatched questions get ``default_route``
    and their inferred tables.
    """
    q = F.col(question_col)
    m = keyword_match(q)
    matched = F.col("_m").isNotNull()
    return (spread(df).withColumn("_m", m)
            .withColumn("route", F.coalesce(F.col("_m.route"), F.lit(default_route)))
            .withColumn("tables", F.coalesce(F.col("_m.fixed_tables"), infer_tables(q)))
            .withColumn("matched_pattern", F.col("_m.pattern"))
            .withColumn("intent", F.when(matched, F.concat(F.lit("Keyword match: "), F.col("_m.pattern")))
                        .otherwise(q))
            .withColumn("method", F.when(matched, F.lit("keyword")).otherwise(F.lit("fallback")))
            .drop("_m"))


def parse_logged_route(answer: Column, question: Column,
                       default_route: str = DEFAULT_ROUTE) -> Column:
    """T-03: struct(route, method, tables, intent) from a logged free-text classifier answer.

    As the reference parses it: of an answer with a fence the text from the first ``{`` to the last ``}``
    counts, of any other the whole answer. It must be one JSON object (strictly: ``try_parse_json``);
    anything else falls back to the default route, with the inferred tables and the question as
    intent. An object with an unknown route, or none, has the default route.
    """
    text = F.trim(answer, F.lit(SPACE_CHARS))
    obj = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    json = F.when(text.contains("```") & (obj != ""), obj).otherwise(text)
    # a parse ends with the first value: wrapped both ways, text after it is an error
    v = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    alone = F.try_parse_json(F.concat(F.lit('{"x":'), json, F.lit("}"))).isNotNull() & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 1)
    part = lambda name: F.try_variant_get(v, f"$[0].{name}", "string")
    is_object = F.coalesce(alone & F.schema_of_variant(v).startswith("ARRAY<OBJECT"), F.lit(False))
    route = F.when(part("route").isin(*VALID_ROUTES), part("route")).otherwise(F.lit(default_route))
    read = F.struct(route.alias("route"), F.lit("llm").alias("method"), part("tables").alias("tables"), part("intent").alias("intent"))
    default = F.struct(F.lit(default_route).alias("route"), F.lit("llm_fallback").alias("method"), infer_tables(question).alias("tables"), question.alias("intent"))
    return F.when(is_object, read).otherwise(default)


def router_accuracy(routed: DataFrame, expected_col: str = "expected_route") -> DataFrame:
    """T-13: share of questions routed as labelled, overall and per method."""
    ok = (F.col("route") == F.col(expected_col)).cast("int")
    return routed.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct"),
        F.round(F.avg(ok) * 100, 1).alias("accuracy_pct"))
