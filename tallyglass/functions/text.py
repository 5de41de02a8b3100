"""Small text rules shared by the operators; all of them are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\f\v"


def quoted(text: str) -> str:
    """A SQL literal, backslashes and all."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stripped_sql(value: str) -> str:
    """SQL for a text without blanks at its ends."""
    return f"btrim({value}, ' \\t\\n\\r\\f\\u000B')"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def rlike_sql(value: str, pattern: str) -> str:
    return f"({value} rlike {quoted(pattern)})"


def percent(ratio: Column, digits: int = 1) -> Column:
    """`0.992` as `99.2%`."""
    return F.format_string(f"%.{digits}f%%", ratio * 100)


def words(name: Column) -> Column:
    """Lower-case word parts of an identifier."""
    return F.filter(F.split(F.lower(name), r"[_\W]+"), lambda w: w != "")


def contains_any(name: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for part in parts:
        hit = hit | low.contains(part)
    return hit


def has_word(name: Column, candidates: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words(name), F.array(*[F.lit(c) for c in candidates]))
