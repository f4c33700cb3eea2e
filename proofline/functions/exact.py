"""Exact numbers, dates and names read from text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number as printed, the grades, and the hyphens folded to "-".
NUMBER = r"^\s*(-?\d+(?:\.\d+)?)\s*$"
NUMBERS = r"\d+(?:\.\d+)?"
GRADES = ("Observation", "Minor", "Major", "Critical")
HYPHENS = "[‐‑‒–—―−]"
DECIMAL = "decimal(18,6)"


def exact_text(text: Column) -> Column:
    """The printed digits of a number, or null: units, exponents and stray letters are not repaired."""
    return F.when(text.rlike(NUMBER), F.regexp_extract(text, NUMBER, 1))


def exact(text: Column, kind: str = DECIMAL) -> Column:
    """The number itself as a decimal, or null if the text is not exactly a number."""
    return exact_text(text).try_cast(kind)


def printed_decimals(text: Column) -> Column:
    """How many digits are printed after the point; null if the text is not a number."""
    return F.when(exact_text(text).isNotNull(), F.length(F.regexp_extract(text, r"\.(\d+)\s*$", 1)))


def bare(text: Column) -> Column:
    """Letters and digits alone, in lower case: how template words and clauses are compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def iso_date(text: Column) -> Column:
    """A printed day-month-year date; null if there is no such day."""
    return F.try_to_timestamp(text, F.lit("d-M-yyyy")).cast("date")


def grade_rank(severity: Column) -> Column:
    """0 for the mildest grade upwards; null for anything that is not a grade."""
    at = F.array_position(F.array(*map(F.lit, GRADES)), severity)
    return F.when(at > 0, at - 1).cast("int")


def squeezed(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy(text: Column) -> Column:
    """Text as scorers compare it: spaces collapsed, dashes folded, lower case, null as empty."""
    return F.lower(squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), "[—–]", "-")))


def names_token(text: Column, name: Column) -> Column:
    """Whether a text names something as a whole token (not inside a longer word or hyphenated name)."""
    quoted = F.regexp_replace(name, r"([^A-Za-z0-9])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![\w-])"), quoted, F.lit(r"(?![\w-])")))
