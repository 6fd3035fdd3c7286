"""Small helpers that write DuckDB SQL text for the oracles."""

from __future__ import annotations


def unpivot(source: str, section: str, key_expr: str, measures: list[str]) -> str:
    """``SELECT section, key, measure, value`` rows for each measure of ``source``."""
    parts = [
        f"SELECT '{section}' AS section, CAST({key_expr} AS VARCHAR) AS key, "
        f"'{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {source}"
        for m in measures
    ]
    return "\nUNION ALL\n".join(parts)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
