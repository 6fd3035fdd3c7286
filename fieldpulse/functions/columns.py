"""Reusable Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse.functions.regex import SPACE_CHARS

MICROS_PER_DAY = 86_400_000_000

# Fixed value: the text the reference stores for a missing text cell.
NULL_TOKEN = "nan"

# Characters that count as "word" characters for a Unicode-aware \b; written as
# explicit classes so Spark (Java regex) and DuckDB (RE2) agree with each other
# and with Python's default Unicode \b.
WORD_CLASS = r"\p{L}\p{N}_"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_micros(as_of: str | datetime) -> int:
    """Microseconds since the epoch for a UTC wall-clock time."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    delta = as_of - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def ts_micros(c: str | Column) -> Column:
    """Epoch micros of a timestamp or timestamp_ntz column (naive = UTC)."""
    return F.unix_micros(col_of(c).cast("timestamp"))


def is_before(c: str | Column, as_of: str | datetime) -> Column:
    return ts_micros(c) < F.lit(as_of_micros(as_of))


def elapsed_days(c: str | Column, as_of: str | datetime) -> Column:
    """Whole elapsed 24-hour days from ``c`` to ``as_of``; negative or NULL -> 0.

    Elapsed, not calendar: 2026-01-01 12:00 -> 2026-01-03 00:00 is 1 day.
    """
    days = F.floor((F.lit(as_of_micros(as_of)) - ts_micros(c)) / F.lit(float(MICROS_PER_DAY)))
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), days), F.lit(0).cast("bigint"))


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()``: leading/trailing Unicode whitespace (SQL ``trim`` only strips spaces).

    ``trim`` with a character set touches only the two ends of the string.
    """
    return F.trim(col_of(c), F.lit(SPACE_CHARS))


def standardise_text(c: str | Column, null_token: str | None = NULL_TOKEN) -> Column:
    """Trim; NULL becomes ``null_token`` (the reference's ``'nan'``), or stays NULL."""
    out = strip_ws(c)
    return out if null_token is None else F.coalesce(out, F.lit(null_token))


def has_text(c: str | Column, null_token: str = NULL_TOKEN) -> Column:
    """Not NULL, not blank after trimming, and not the missing-value token."""
    x = col_of(c)
    return x.isNotNull() & (F.trim(x) != F.lit("")) & (x != F.lit(null_token))


# Decimal number text as a lenient numeric parser (the reference's) accepts
# it: sign, digits with an optional point, optional exponent, or the words
# inf / infinity / nan; surrounding whitespace allowed. Java's parser behind
# Spark's cast would also take type suffixes ("1.5d") and hex floats.
DECIMAL_TEXT = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def coerce_number(c: str | Column, default: float | None = 0.0, numeric: bool = False) -> Column:
    """Text or number -> double; unparseable, NULL or NaN -> ``default``.

    Text must be decimal number syntax (``DECIMAL_TEXT``); a finite-looking
    text that overflows to infinity counts as unparseable. ``numeric=True``
    when the input is already a number (no text round trip).
    """
    x = col_of(c)
    if numeric:
        d = x.cast("double")
    else:
        txt = x.cast("string")
        d = F.when(txt.rlike(DECIMAL_TEXT), txt.try_cast("double"))
        overflow = (F.abs(d) == F.lit(float("inf"))) & ~F.lower(txt).contains("inf")
        d = F.when(~overflow, d)
    d = F.nanvl(d, F.lit(None).cast("double"))
    return d if default is None else F.coalesce(d, F.lit(float(default)))


def clamp_pct(c: str | Column, fill: float | None = 0.0) -> Column:
    """NULL/NaN -> ``fill`` (0; None keeps NULL), then clamp into [0, 100].

    NaN must be handled first: ``least`` ranks NaN highest.
    """
    x = F.nanvl(col_of(c).cast("double"), F.lit(None).cast("double"))
    if fill is not None:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(x, F.lit(float(fill)))))
    # greatest/least skip NULLs (least(100, NULL) is 100), so NULL passes through explicitly
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


# Full ISO dates with an optional time, fraction and zone. (A bare cast would also take years alone, and times of today.)
ISO_TIMESTAMP = (r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?"
                 r"(?:\s?(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?))?)?$")
# Formats tried in order when other text is turned into a timestamp.
TIMESTAMP_FORMATS = (
    "yyyy/M/d HH:mm:ss",
    "yyyy/M/d",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy",
)


def coerce_timestamp(c: str | Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS,
                     typed: bool = False) -> Column:
    """Text -> naive (UTC wall-clock) timestamp; anything else -> NULL.

    ISO text first (with any fraction; a zone is converted to UTC), then the
    first of ``formats`` that parses. ``typed=True`` when the input already is a
    date/timestamp (plain cast). The result is ``timestamp_ntz`` so a client in
    another zone reads the same wall-clock value.
    """
    if typed:
        return col_of(c).cast("timestamp_ntz")
    x = strip_ws(col_of(c).cast("string"))
    iso = F.when(x.rlike(ISO_TIMESTAMP), x.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def word_regex(alternatives: str) -> str:
    """Wrap an alternation in Unicode-aware word boundaries portable to Java and RE2."""
    return rf"(?:^|[^{WORD_CLASS}])(?:{alternatives})(?:[^{WORD_CLASS}]|$)"
