"""Row predicates with the text semantics of the rule set (ASCII case folding, NULL propagation)."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TEN_DIGITS = r"^[0-9]{10}\z"
# Marker words of test rows.
TEST_NAME_WORDS = ("test", "dummy", "sample")
TEST_EMAIL_WORDS = ("test", "example", "dummy")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, which is how the rules' LIKE compares."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def is_blank(c: Column) -> Column:
    """NULL, empty or spaces only."""
    return c.isNull() | (F.trim(c) == "")


def like_ci(c: Column, pattern: Column | str) -> Column:
    """LIKE without ASCII case; ``%`` and ``_`` in the pattern are wildcards, a backslash is an ordinary character."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.like(ascii_lower(c), F.replace(ascii_lower(pat), F.lit("\\"), F.lit("\\\\")))


def contains_ci(whole: Column, part: Column) -> Column:
    """``whole LIKE '%' || part || '%'`` without ASCII case. Only a part that holds a wildcard pays for a pattern per row."""
    wild = F.contains(part, F.lit("%")) | F.contains(part, F.lit("_"))
    plain = F.contains(ascii_lower(whole), ascii_lower(part))
    return F.when(wild, like_ci(whole, F.concat(F.lit("%"), part, F.lit("%")))).otherwise(plain)


def has_any_word(c: Column, words: Iterable[str]) -> Column:
    t, hit = ascii_lower(c), None
    for w in words:
        here = F.contains(t, F.lit(w))
        hit = here if hit is None else hit | here
    return hit


def is_ten_digits(c: Column) -> Column:
    return F.rlike(c, F.lit(TEN_DIGITS))


def starts_with_digit(c: Column) -> Column:
    return F.rlike(c, F.lit("^[0-9]"))


def bare_phone(c: Column) -> Column:
    """Phone without brackets and dashes. Spaces stay, so ``(555) 123-4567`` has length 11."""
    return F.translate(c, "()-", "")


def bad_phone_length(c: Column) -> Column:
    return F.length(bare_phone(c)) != 10


def email_shaped(c: Column) -> Column:
    return like_ci(c, "%@%.%")


def first_match(*pairs: tuple[Column, Column | str], default: Column | str | None = None) -> Column:
    """CASE WHEN … chain: the first true condition decides."""
    out = None
    for cond, value in pairs:
        v = F.lit(value) if isinstance(value, str) else value
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if default is None:
        return out
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "CRITICAL", 1).when(severity == "HIGH", 2).when(severity == "MEDIUM", 3).otherwise(4)
    )
