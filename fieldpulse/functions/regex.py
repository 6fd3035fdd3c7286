"""Portable regular expressions.

The reference's rules are Python ``re`` patterns on ``str``: ``\\b``, ``\\w``,
``\\s`` and ``\\d`` are Unicode-aware there, ASCII-only (or inconsistent) in
Java regex (Spark ``rlike``/``regexp_*``) and in RE2 (DuckDB). ``portable``
rewrites a pattern into explicit classes that mean the same thing in all three
engines, so the fixed patterns can be stated verbatim, in the reference's own
spelling, and compiled to Spark column expressions at plan time.

Only the constructs the fixed patterns use are rewritten: ``\\b`` at the start
or end of a pattern, ``\\w``, ``\\s``, ``\\d`` and ``.`` (which excludes only
``\\n`` in Python).
"""

from __future__ import annotations

# Characters for which Python's str.isalnum() holds, plus "_": \w in Python.
WORD = r"\p{L}\p{N}_"
# Characters for which Python's str.isspace() holds (\s in Python), derived
# from Python itself; as a string (for trim) and as class members (for regex).
SPACE_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())
SPACE = "".join(f"\\x{{{ord(ch):x}}}" for ch in SPACE_CHARS)


def _classes(p: str) -> str:
    out, i = [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "w":
                out.append(f"[{WORD}]")
            elif nxt == "s":
                out.append(f"[{SPACE}]")
            elif nxt == "d":
                out.append(r"\p{Nd}")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == ".":
            out.append(r"[^\n]")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def portable(pattern: str) -> str:
    """Rewrite a Python pattern so Java regex and RE2 match exactly where Python does.

    A leading/trailing ``\\b`` becomes a consumed boundary character
    (``(?:^|[^\\w])`` / ``(?:[^\\w]|$)``); this is equivalent for *search*
    (does the pattern occur anywhere), which is how the rules are used, when
    the pattern's first/last characters are word characters.
    """
    lead = pattern.startswith(r"\b")
    trail = pattern.endswith(r"\b") and not pattern.endswith(r"\\b")
    core = pattern[2 if lead else 0: len(pattern) - (2 if trail else 0)]
    core = _classes(core)
    if lead:
        core = rf"(?:^|[^{WORD}])" + core
    if trail:
        core = core + rf"(?:[^{WORD}]|$)"
    return core


def portable_strip_pattern() -> str:
    """Leading or trailing whitespace as Python's ``str.strip()`` sees it."""
    return rf"^[{SPACE}]+|[{SPACE}]+$"


def _top_level_alternatives(p: str) -> list[str]:
    out, depth, cur, i = [], 0, [], 0
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            cur.append(p[i:i + 2])
            i += 2
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
        i += 1
    out.append("".join(cur))
    return out


def required_literals(pattern: str) -> list[str]:
    """Literal strings one of which must occur wherever ``pattern`` matches.

    Used as a cheap ``contains`` prefilter in front of regex chains. Handles
    the shapes of the fixed patterns: an optional ``\\b`` and one capturing
    group around a top-level alternation, each alternative starting with a
    literal run. Returns ``[]`` (no prefilter possible) otherwise.
    """
    core = pattern
    if core.startswith(r"\b"):
        core = core[2:]
    if core.endswith(r"\b"):
        core = core[:-2]
    if core.startswith("(") and core.endswith(")") and not core.startswith("(?"):
        core = core[1:-1]
    lits = []
    for alt in _top_level_alternatives(core):
        run = []
        for ch in alt:
            if ch.isalnum() or ch in "-;_& ":
                run.append(ch)
            else:
                break
        if not run:
            return []
        lits.append("".join(run))
    return lits


def contains_any(text, literals: list[str]):
    """Column: ``text`` contains at least one of ``literals`` (fast byte search, no regex)."""
    cond = None
    for lit in dict.fromkeys(literals):
        c = text.contains(lit)
        cond = c if cond is None else (cond | c)
    return cond


def prefilter(text, patterns) -> "object | None":
    """A ``contains`` gate that every match of any of ``patterns`` passes, or None."""
    lits = []
    for p in patterns:
        req = required_literals(p)
        if not req:
            return None
        lits += req
    return contains_any(text, lits)
