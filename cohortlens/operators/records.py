"""Scores and issue lists per record, and match keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col, lit = F.col, F.lit

# Facility types that the schema accepts.
FACILITY_TYPES = (
    "Hospital", "Outpatient Clinic", "Urgent Care", "Surgery Center", "Diagnostic Center", "Rehabilitation Center",
    "Nursing Home", "Private Practice", "Community Health Center", "Academic Medical Center",
)


def _opt(df: DataFrame, name: str) -> Column:
    """The column, or NULL text when the table has none of that name."""
    return col(name) if name in df.columns else lit(None).cast("string")


def _filled(c: Column) -> Column:
    return F.coalesce(F.rlike(c.cast("string"), lit(r"\S")), lit(False))


def _filled_number(c: Column) -> Column:
    """A number of 0 counts as not filled here."""
    return F.coalesce(c != 0, lit(False))


def _share(flags: Sequence[Column]) -> Column:
    total = lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total / len(flags)


def _issues(*checks: tuple[Column, Column | str]) -> Column:
    """Text of the failing checks, joined by '; ' ('' when none fails)."""
    return F.concat_ws("; ", *[F.when(c, lit(t) if isinstance(t, str) else t) for c, t in checks])


def _blank(c: Column) -> Column:
    return ~_filled(c)


def _has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def provider_completeness(df: DataFrame) -> DataFrame:
    npi = col("npi_number")
    pct = lambda *names: _share([_filled(col(n)) for n in names]) * 100
    return df.select(
        "*",
        F.coalesce(F.rlike(npi, lit(r"^[0-9]{10}\z")), lit(False)).alias("has_valid_npi"),
        pct("full_name", "first_name", "last_name").alias("name_completeness"),
        pct("email", "phone_number").alias("contact_completeness"),
        pct("license_number", "license_state").alias("license_completeness"),
    )


def _provider_overall(df: DataFrame) -> Column:
    core = [_filled(col(n)) for n in
            ("full_name", "first_name", "last_name", "specialty_primary", "license_number", "license_state")]
    extra = [_filled(col("npi_number")), _filled(col("email")), _filled(col("phone_number")), _filled(_opt(df, "degree")),
             _filled_number(col("years_in_practice"))]
    return (_share(core) * 0.7 + _share(extra) * 0.3) * 100


def provider_overall(df: DataFrame) -> DataFrame:
    return df.withColumn("completeness_score", _provider_overall(df))


def provider_issues(df: DataFrame) -> DataFrame:
    npi, state, email = col("npi_number"), col("license_state"), col("email")
    birth, practice = col("birth_year"), col("years_in_practice")
    # Issue texts, in their order.
    issues = _issues(
        (_blank(col("full_name")), "Missing or empty full name"),
        (_blank(col("last_name")), "Missing or empty last name"),
        (_has_text(npi) & ~F.rlike(npi, lit(r"^[0-9]{10}\z")), "Invalid NPI number format"),
        (_has_text(state) & (F.length(state) != 2), "Invalid license state format"),
        (_has_text(email) & ~F.contains(email, lit("@")), "Invalid email format"),
        ((birth != 0) & ((birth < 1920) | (birth > 2005)), "Unrealistic birth year"),
        ((practice < 0) | (practice > 60), "Invalid years in practice"),
    )
    return df.select("*", issues.alias("issues"), (issues == "").alias("is_valid"),
                     _provider_overall(df).alias("completeness_score"))


def _facility_overall(df: DataFrame) -> Column:
    core = [_filled(_opt(df, n)) for n in ("facility_name", "facility_type", "address_line1", "city", "state_province")]
    extra = [_filled(_opt(df, n)) for n in ("postal_code", "phone", "email", "bed_count", "organization_type")]
    return (_share(core) * 0.8 + _share(extra) * 0.2) * 100


def facility_completeness(df: DataFrame) -> DataFrame:
    pct = lambda *names: _share([_filled(_opt(df, n)) for n in names]) * 100
    return df.select(
        "*",
        pct("address_line1", "city", "state_province", "postal_code").alias("address_completeness"),
        pct("phone", "email", "website").alias("contact_completeness"),
        _facility_overall(df).alias("completeness_score"),
    )


def _clean_postal(c: Column) -> Column:
    return F.translate(c, "- ", "")


def facility_issues(df: DataFrame) -> DataFrame:
    postal, email, ftype = _opt(df, "postal_code"), _opt(df, "email"), _opt(df, "facility_type")
    issues = _issues(
        (_blank(_opt(df, "facility_name")), "Missing or empty facility name"),
        (_blank(_opt(df, "address_line1")), "Missing street address"),
        (_blank(_opt(df, "city")), "Missing city"),
        (_blank(_opt(df, "state_province")), "Missing state/province"),
        (_has_text(postal) & ~F.rlike(_clean_postal(postal), lit(r"^([0-9]{5}|[0-9]{9})\z")), "Invalid postal code format"),
        (_has_text(email) & ~F.contains(email, lit("@")), "Invalid email format"),
        (_opt(df, "bed_count") <= 0, "Invalid bed count"),
        (_has_text(ftype) & ~ftype.isin(list(FACILITY_TYPES)), F.concat(lit("Unrecognized facility type: "), ftype)),
    )
    return df.select("*", issues.alias("issues"), (issues == "").alias("is_valid"),
                     _facility_overall(df).alias("completeness_score"))


def facility_address(df: DataFrame) -> DataFrame:
    """Full address text and the ``CITY|STATE|ZIP5`` key used to match locations."""
    part = lambda n: F.when(_has_text(_opt(df, n)), F.trim(_opt(df, n)))
    city_line = F.concat_ws(", ", part("city"), part("state_province"), part("postal_code"))
    country = F.when(_opt(df, "country") != "USA", part("country"))
    full = F.concat_ws("\n", part("address_line1"), part("address_line2"), F.when(city_line != "", city_line), country)
    zip_digits = _clean_postal(_opt(df, "postal_code"))
    upper = lambda n: F.when(_has_text(_opt(df, n)), F.trim(F.upper(_opt(df, n))))
    key = F.concat_ws("|", upper("city"), upper("state_province"),
                      F.when(F.length(zip_digits) >= 5, F.substring(zip_digits, 1, 5)))
    return df.select("*", full.alias("full_address"), key.alias("geographic_key"))
