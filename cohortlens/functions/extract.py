"""Values read out of semi-structured text cells, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit

# Patterns of the values read out of text.
INTEGERS = r"\d+"
PERCENT = r"(\d+(?:\.\d+)?)%"
ODDS_RATIO = r"OR[:\s]*(\d+\.?\d*)"
PATIENTS = r"patients:\s*(\d+)"
SENSITIVITY = r"(?i)sensitivity[:\s]*(\d+(?:\.\d+)?)"
SPECIFICITY = r"(?i)specificity[:\s]*(\d+(?:\.\d+)?)"
DECIMAL = r"\d+\.?\d*"


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when the text has none."""
    return F.nullif(F.regexp_extract(c, pattern, group), lit(""))


def first_integer(c: Column) -> Column:
    return first_group(c, INTEGERS, 0).try_cast("bigint")


def all_integers(c: Column) -> Column:
    return F.regexp_extract_all(c, lit(INTEGERS), lit(0)).cast("array<bigint>")


def first_decimal(c: Column) -> Column:
    return first_group(c, DECIMAL, 0).try_cast("double")


def patients(c: Column) -> Column:
    return first_group(c, PATIENTS).try_cast("bigint")


def all_patients(c: Column) -> Column:
    return F.regexp_extract_all(c, lit(PATIENTS), lit(1)).cast("array<bigint>")


def first_percent(c: Column) -> Column:
    return first_group(c, PERCENT).try_cast("double")


def all_percents(c: Column) -> Column:
    return F.regexp_extract_all(c, lit(PERCENT), lit(1)).cast("array<double>")


def odds_ratio(c: Column) -> Column:
    return F.when(F.contains(c, lit("OR")), first_group(c, ODDS_RATIO).try_cast("double"))


def sensitivity(c: Column) -> Column:
    return first_group(c, SENSITIVITY).try_cast("double")


def specificity(c: Column) -> Column:
    return first_group(c, SPECIFICITY).try_cast("double")


def array_mean(c: Column) -> Column:
    """Mean of an array, NULL when it is empty."""
    total = F.aggregate(c, lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(c) > 0, total / F.size(c))


def age_mean(c: Column) -> Column:
    """One number in the text is the age; several are averaged."""
    return array_mean(F.regexp_extract_all(c, lit(DECIMAL), lit(0)).cast("array<double>"))


# Age bands, upper bound inclusive.
AGE_BANDS = ((18, "pediatric"), (40, "young_adult"), (65, "middle_aged"), (100, "elderly"))


def age_group(age: Column) -> Column:
    out = F.when(age <= 0, lit(None).cast("string"))
    for hi, name in AGE_BANDS:
        out = out.when(age <= hi, name)
    return out


def yes_flag(c: Column) -> Column:
    return F.startswith(F.lower(c), lit("y"))


def severity_from_text(c: Column) -> Column:
    """severe 3, critical 4, mild 1 (tested in that order), else 2."""
    t = F.lower(c)
    has = lambda w: F.contains(t, lit(w))
    return F.when(has("severe"), 3).when(has("critical"), 4).when(has("mild"), 1).otherwise(2)


def split_cell(c: Column) -> Column:
    """Values of a ';' cell, trimmed; '-' and empty values are dropped."""
    parts = F.transform(F.split(c, ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "-"))


def title_case(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))


def ordered_score(c: Column, table: Sequence[tuple[str, int]], default: int = 0) -> Column:
    """Score of the first key contained in the text (case ignored)."""
    t = F.lower(c)
    out = None
    for key, score in table:
        hit = F.contains(t, lit(key.lower()))
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(default)


def fingerprint(c: Column) -> Column:
    """16 hex digits naming a query text."""
    return F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 16)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased text padded with two spaces before and one after."""
    t = F.concat(lit("  "), F.lower(c), lit(" "))
    return F.array_distinct(F.transform(F.sequence(lit(1), F.length(t) - 2), lambda i: F.substring(t, i, lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 to 1."""
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))


def const_map(m: Mapping[str, float | str]) -> Column:
    return F.create_map(*[x for k, v in m.items() for x in (lit(k), lit(v))])
