"""Personal data by weak supervision (op 1), DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.
Further candidates (names, national ids, account numbers, phone numbers without
a country code) come from wider patterns. On every candidate five labelers vote
-1, 0 or 1: a shape regex, a gazetteer, cues before the span, its borders and a
checksum. Expectation-maximisation over the counts of equal vote patterns
estimates how reliable each labeler is, without labels, and gives each pattern
a probability; a logistic span classifier is trained on these and decides which
further candidates become spans.

The texts are scanned once. Candidates with their votes go to a scratch table;
the pattern counts are one aggregate over all of it. At most
(kinds * 3 ** labelers) patterns reach the driver, where EM and the classifier
run on that bounded table; the classifier returns to the plan as an expression.

Positions come from ``split`` and ``regexp_extract_all`` with the same pattern:
the pieces between the matches and the matches add up to the offsets.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.common import written

#: Base patterns. Each means the same as the contract's pattern, leftmost and
#: without overlap, but can't go back: a match may start only where a run of its
#: first class starts or where the last match ended (\\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates. Those that overlap a base span are left out.
FURTHER = {
    "name": r"(?<![A-Za-z])[A-Z][a-z]{1,14}+ [A-Z][a-z]{1,14}+(?![A-Za-z])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
KINDS = (*BASE, *FURTHER)
#: Further kinds whose check proves that a candidate is nobody's, as Luhn does for cards.
PROOF = ("national", "account")
LABELERS = ("shape", "listed", "cues", "borders", "check")

# Gazetteers and cue words
GIVEN_NAMES = ("Alice", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "David", "Elizabeth", "Emma", "Hans", "James",
               "Jean", "John", "Jose", "Julia", "Karl", "Laura", "Linda", "Lucia", "Luis", "Maria", "Marie", "Mary", "Michael",
               "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Thomas", "William")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "biz", "de", "fr", "es", "uk", "eu", "it", "ch", "at", "us", "ca")
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CARD_STARTS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|addr", "card": "card|visa|master|amex|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|ruf", "name": "name|mr|mrs|ms|dr|herr|frau|madame|monsieur|signed|by",
    "national": "ssn|social|security|id", "account": "iban|account|konto|cuenta|compte", "local": "phone|tel|call|mobile|fax|ruf",
}
#: Area codes of the larger cities of the numbering plan that ``local`` follows.
AREA_CODES = ("201", "202", "206", "212", "213", "214", "215", "301", "303", "305", "310", "312", "313", "314", "317", "404", "408", "410", "412", "415",
              "416", "469", "503", "504", "509", "510", "512", "514", "516", "602", "604", "612", "614", "615", "617", "619", "646", "650", "702", "703",
              "704", "713", "714", "716", "718", "720", "773", "778", "800", "801", "802", "804", "813", "816", "817", "818", "832", "847", "858", "877",
              "888", "901", "904", "914", "915", "916", "917", "919", "925", "949", "954", "972", "973")
#: Numbers that were printed in public and are nobody's.
VOID_NATIONAL = ("078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789")
#: Capitalised words that begin sentences or stand in titles.
NOT_NAMES = ("The", "This", "That", "These", "Those", "At", "In", "On", "Of", "And", "Or", "But", "For", "From", "With", "To", "It", "He", "She", "We",
             "You", "They", "Is", "Are", "Was", "If", "As", "By", "An", "Not", "License", "Licence", "Public", "General", "Version", "Street", "Avenue",
             "University", "Company", "Inc", "Corporation", "Foundation", "Copyright", "All", "Rights", "Software", "Apache", "Der", "Die", "Das", "Und",
             "Le", "La", "Les", "Des", "Et", "El", "Los", "Las", "Un", "Une", "Una")
AGAINST = "version|isbn|order|invoice|token|sha|page|chapter|figure|section|key"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _mod97(s: Column) -> Column:
    """Whether an account number's check digits are right: its first four signs moved to the end and letters as 10 to 35, it leaves 1 modulo 97."""
    signs = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code <= 57, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _passes(kind: str, s: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0).cast("int")


def _in_or_not(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1).cast("int")


def _shape(kind: str, s: Column) -> Column:
    return {
        "email": lambda: _in_or_not(s.rlike(r"^[^@]{1,64}@[^@]+\.[A-Za-z]{2,24}$")),
        "ip": lambda: _in_or_not(~s.rlike(r"(^|\.)0[0-9]")),
        "card": lambda: _in_or_not(F.length(_digits(s)).isin(15, 16)),
        "phone": lambda: _vote(s.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]")),
        "name": lambda: _in_or_not(s.rlike(r"^[A-Z][a-z]{2,10} [A-Z][a-z]{2,12}$")),
        # neither one digit throughout nor digits counted up or down
        "national": lambda: _in_or_not(~_digits(s).rlike(r"^([0-9])\1{8}$") & ~_digits(s).isin("012345678", "123456789", "987654321", "876543210")),
        "account": lambda: _in_or_not(F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34)),
        "local": lambda: _in_or_not(s.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^([0-9]{3})([.-])[0-9]{3}\2[0-9]{4}$")),
    }[kind]()


def _listed(kind: str, s: Column) -> Column:
    return {
        "email": lambda: _in_or_not(F.lower(F.substring_index(s, ".", -1)).isin(*TOP_DOMAINS)),
        "ip": lambda: _vote(~s.rlike(r"^(0|127|255)\."), s.rlike(r"^(0|127|255)\.")),
        "card": lambda: _in_or_not(_digits(s).rlike(CARD_STARTS)),
        "phone": lambda: _vote(s.rlike(r"^\+(1|33|34|39|41|43|44|49|52|54|55|61|81|86|91)")),
        "name": lambda: _in_or_not(F.substring_index(s, " ", 1).isin(*GIVEN_NAMES)),
        # area numbers given out by state
        "national": lambda: _vote(F.substring(s, 1, 3).cast("int").between(1, 772) & ~s.startswith("666")),
        "account": lambda: _in_or_not(F.substring(s, 1, 2).isin(*ACCOUNT_COUNTRIES)),
        "local": lambda: _vote(F.substring(_digits(s), 1, 3).isin(*AREA_CODES)),
    }[kind]()


def _check(kind: str, s: Column) -> Column:
    """Check digits, or where a kind has none the rules of its numbers and names. (Luhn and 0 to 255 hold for every card and ip: these are what is left.)"""
    digits = _digits(s)
    return {
        "email": lambda: _in_or_not(~s.rlike(r"^\.|\.\.|\.@|@-|-\.|\.-|-$") & ~F.substring_index(s, ".", -1).rlike("^[0-9]+$")),
        "ip": lambda: _in_or_not(s.rlike(r"^0*([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.") & ~s.rlike(r"\.0*(0|255)$")),  # a single host's
        "card": lambda: _in_or_not(digits.rlike("^(4([0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|(6011|65[0-9]{2})[0-9]{12,15})$")),
        "phone": lambda: _in_or_not(~digits.startswith("0") & (~digits.startswith("1") | digits.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"))),
        "name": lambda: _vote(F.lit(False), s.rlike(r"^([A-Za-z]+) \1$") | F.substring_index(s, " ", 1).isin(*NOT_NAMES) | F.substring_index(s, " ", -1).isin(*NOT_NAMES)),
        "national": lambda: _in_or_not(~s.rlike(r"^(000|666|9..)|-00-|-0000$") & ~s.isin(*VOID_NATIONAL)),
        "account": lambda: _in_or_not(_mod97(s)),
        "local": lambda: _in_or_not(digits.rlike("^[2-9][0-8][0-9][2-9][0-9]{6}$") & ~digits.rlike("^([0-9]{3})?[2-9]11")),
    }[kind]()


def _spans(kind: str, text: Column, found: Column, pieces: Column) -> Column:
    """struct(kind, start, end, five votes, base) of every match."""

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), F.get(found, i).alias("m")))).alias("out"))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    placed = F.when(F.size(found) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])).otherwise(none)

    def votes(x: Column) -> Column:
        left = F.lower(F.substring(text, F.greatest(x["s"] - 24, F.lit(0)) + 1, F.least(x["s"], F.lit(24))))
        edge = r"[\p{L}\p{N}]"
        after = F.substring(text, x["e"] + 1, F.lit(1))
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
            _shape(kind, x["m"]).cast("int").alias("shape"), _listed(kind, x["m"]).cast("int").alias("listed"),
            _vote(left.rlike(rf"\b({CUES[kind]})\b[^\n]{{0,12}}$"), left.rlike(rf"\b({AGAINST})\b[^\n]{{0,12}}$")).alias("cues"),
            _in_or_not(~left.rlike(edge + "$") & ~after.rlike(edge)).alias("borders"),
            _check(kind, x["m"]).cast("int").alias("check"), F.lit(kind in BASE).alias("base"))

    return F.transform(F.filter(placed, lambda x: _passes(kind, x["m"])) if kind in BASE else placed, votes)


def candidates(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (with ``carry`` the whole row as ``_row``) and ``cands``: base spans and further candidates with their votes, by kind and start."""
    text = F.col("_text")
    own = ["_row"] if carry else ["doc_id"]
    rows = docs.select(F.struct("*").alias("_row") if carry else "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    patterns = BASE | FURTHER
    # cheap tests spare most texts the email and phone scans
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({
        f"_m_{k}": F.when(may[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(empty) if k in may else F.regexp_extract_all(text, F.lit(p), F.lit(0))
        for k, p in patterns.items()})
    rows = rows.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    spans = {k: _spans(k, text, F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in patterns}
    rows = rows.select(*own, F.concat(*[spans[k] for k in BASE]).alias("_base"), F.concat(*[spans[k] for k in FURTHER]).alias("_more"))
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return rows.select(*own, F.concat("_base", F.filter("_more", clear)).alias("cands"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """EM over (kind, votes, count): P(personal data) of each pattern.

    Each labeler has, for either truth, a probability of each of its votes; a
    labeler that does not vote says nothing. Each kind has a prior. Start: the
    share of positive votes.
    """
    post = {(k, v): (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for k, v, _ in patterns}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        seen = [[{-1: 1.0, 1: 1.0} for _ in LABELERS] for _ in range(2)]
        for k, v, n in patterns:
            p = post[k, v]
            own = prior.setdefault(k, [1.0, 1.0])
            for truth, share in ((0, 1 - p), (1, p)):
                own[truth] += n * share
                for j, x in enumerate(v):
                    if x:
                        seen[truth][j][x] += n * share
        logs = [[{x: math.log(c / sum(t.values())) for x, c in t.items()} for t in side] for side in seen]
        for k, v, _ in patterns:
            odds = math.log(prior[k][1] / prior[k][0]) + sum(logs[1][j][x] - logs[0][j][x] for j, x in enumerate(v) if x)
            post[k, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post


def train(patterns: list[tuple[str, tuple[int, ...], int]], post: dict, rounds: int = 400, rate: float = 0.5,
          keep: float = 1e-3) -> tuple[dict[str, float], list[float]]:
    """Logistic span classifier on the estimated labels: a bias for each kind, a weight for each labeler."""
    bias, weights = {k: 0.0 for k in KINDS}, [0.0] * len(LABELERS)
    # each pattern weighs by the logarithm of its count: frequent kinds don't drown the others
    rows = [(k, v, math.log1p(n), post[k, v]) for k, v, n in patterns]
    total = sum(n for _, _, n, _ in rows) or 1.0
    for _ in range(rounds):
        db, dw = {k: keep * b for k, b in bias.items()}, [keep * w for w in weights]
        for k, v, n, p in rows:
            miss = (1 / (1 + math.exp(-(bias[k] + sum(w * x for w, x in zip(weights, v))))) - p) * n / total
            db[k] += miss
            for j, x in enumerate(v):
                dw[j] += miss * x
        bias = {k: b - rate * db[k] * 8 for k, b in bias.items()}
        weights = [w - rate * d * 8 for w, d in zip(weights, dw)]
    return bias, weights


def scored(x: Column, bias: dict[str, float], weights: list[float]) -> Column:
    """The classifier's log-odds of a candidate, as an expression."""
    out = F.lit(0.0)
    for k, b in bias.items():
        out = out + F.when(x["kind"] == k, b).otherwise(0.0)
    for name, w in zip(LABELERS, weights):
        out = out + x[name] * F.lit(w)
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of struct(kind, start, end, base), by kind as listed, then start.

    Null texts count as empty; repeated rows each get a row; an empty table
    gives none. Base spans always stay.
    """
    return _classified(docs, False)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of the texts replaced by its kind (null texts stay null)."""
    found = _classified(docs, True)
    columns = [masked(F.col("_row.text"), F.col("spans")).alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    return found.select(*columns)


def _classified(docs: DataFrame, carry: bool) -> DataFrame:
    cands = written(candidates(docs, carry), "pii")
    one = cands.select(F.explode("cands").alias("c"))
    counts = one.groupBy("c.kind", *[f"c.{x}" for x in LABELERS]).count().collect()  # at most kinds * 3 ** labelers rows
    patterns = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in counts)
    bias, weights = train(patterns, estimate(patterns))
    stay = F.filter("cands", lambda c: c["base"] | ((scored(c, bias, weights) > 0) & ~(c["kind"].isin(*PROOF) & (c["check"] < 0))))
    return cands.select("_row" if carry else "doc_id", F.transform(stay, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <kind>; overlapping spans merge into the first one's."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_place, start, add, lambda acc: F.concat(
        F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text)))))


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns: counts and digests of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return spans.select("doc_id", *[n(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
