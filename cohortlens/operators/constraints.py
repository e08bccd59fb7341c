"""Schema constraints as queries that list the violations: ``constraint_name, key, value``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.predicates import is_ten_digits, starts_with_digit
from cohortlens.operators.records import FACILITY_TYPES

col, lit = F.col, F.lit

# Code lists of the schema.
GENDERS = ("Male", "Female", "Other", "Unknown")
RECORD_STATUS = ("ACTIVE", "INACTIVE", "PENDING", "MERGED", "DUPLICATE")
VALIDATION_STATUS = ("PENDING", "VERIFIED", "FAILED", "MANUAL_REVIEW")
ACTIVITY_TYPES = ("CLINICAL", "RESEARCH", "ADMINISTRATIVE", "EDUCATION", "PUBLICATION")
EMPLOYMENT_TYPES = ("Full-time", "Part-time", "Consulting", "Locum", "Volunteer", "Academic")
QUALITY_GRADES = ("A", "B", "C", "D", "F")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
VIOLATION_STATUS = ("OPEN", "IN_PROGRESS", "RESOLVED", "FALSE_POSITIVE", "ACCEPTED_RISK")
ENTITY_TYPES = ("PROVIDER", "FACILITY", "AFFILIATION", "ACTIVITY")


def check_rows(df: DataFrame, key: Column, checks: Mapping[str, tuple[str | Column, Column]]) -> DataFrame:
    """``checks``: name -> (value shown, predicate that must not be FALSE). NULL passes, as in a CHECK."""
    found = F.array(*[
        F.when(~ok, F.struct(lit(name).alias("constraint_name"),
                             (col(v) if isinstance(v, str) else v).cast("string").alias("value")))
        for name, (v, ok) in checks.items()])
    return (
        df.select(key.cast("string").alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
        .select("v.constraint_name", "key", "v.value"))


def _present(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> dict[str, tuple[str, Column]]:
    return {n: c for n, c in checks.items() if c[0] in df.columns}


def _in(name: str, values: Sequence[str]) -> Column:
    return col(name).isin(list(values))


def _range(name: str, lo: float, hi: float) -> Column:
    return (col(name) >= lo) & (col(name) <= hi)


def provider_checks(df: DataFrame) -> DataFrame:
    npi = col("npi_number")
    return check_rows(df, col("provider_id"), _present(df, {
        "chk_npi_format": ("npi_number", (F.length(npi) == 10) & is_ten_digits(npi)),
        "chk_license_state": ("license_state", F.length("license_state") == 2),
        "chk_gender": ("gender", _in("gender", GENDERS)),
        "chk_record_status": ("record_status", _in("record_status", RECORD_STATUS)),
        "chk_confidence_range": ("source_confidence", _range("source_confidence", 0, 1)),
        "chk_birth_year": ("birth_year", _range("birth_year", 1920, 2005)),
        "chk_years_practice": ("years_in_practice", _range("years_in_practice", 0, 60)),
    }))


def facility_checks(df: DataFrame) -> DataFrame:
    postal = col("postal_code")
    return check_rows(df, col("facility_id"), _present(df, {
        "chk_facility_type": ("facility_type", _in("facility_type", FACILITY_TYPES)),
        "chk_postal_code_format": ("postal_code", F.length(postal).isin(5, 10) & starts_with_digit(postal)),
        "chk_validation_status": ("validation_status", _in("validation_status", VALIDATION_STATUS)),
        "chk_bed_count": ("bed_count", col("bed_count") > 0),
    }))


def activity_checks(df: DataFrame) -> DataFrame:
    return check_rows(df, col("activity_id"), _present(df, {
        "chk_activity_type": ("activity_type", _in("activity_type", ACTIVITY_TYPES)),
        "chk_patient_count": ("patient_count", col("patient_count") >= 0),
        "chk_citation_count": ("citation_count", col("citation_count") >= 0),
        "chk_author_position": ("author_position", col("author_position") > 0),
    }))


def unique_violations(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """Key combinations held by several rows (all parts non-NULL); ``value`` is the row count."""
    whole = lit(True)
    for c in cols:
        whole = whole & col(c).isNotNull()
    return (
        df.where(whole).groupBy(*cols).agg(F.count(lit(1)).alias("n")).where(col("n") > 1)
        .select(lit(name).alias("constraint_name"),
                F.concat_ws("|", *[col(c).cast("string") for c in cols]).alias("key"), col("n").cast("string").alias("value")))


def not_null_violations(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return check_rows(df, col(key), {f"nn_{c}": (c, F.coalesce(col(c).isNotNull(), lit(False))) for c in cols})


def foreign_key_violations(df: DataFrame, name: str, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    missing = df.where(col(column).isNotNull()).join(
        parent.select(col(parent_key).alias(column)), column, "left_anti")
    return missing.select(lit(name).alias("constraint_name"), col(key).cast("string").alias("key"),
                          col(column).cast("string").alias("value"))


def affiliation_checks(df: DataFrame) -> DataFrame:
    rows = check_rows(df, F.concat_ws("|", "provider_id", "facility_id"), {
        "chk_date_logic": ("end_date", col("start_date") <= col("end_date")),
        **_present(df, {
            "chk_employment_type": ("employment_type", _in("employment_type", EMPLOYMENT_TYPES)),
            "chk_confidence_score": ("confidence_score", _range("confidence_score", 0, 1)),
        })})
    return rows.unionByName(
        unique_violations(df, "unique_provider_facility_start", ("provider_id", "facility_id", "start_date")))


def _score_check() -> Column:
    """The score check mixes AND and OR without brackets; AND binds first, so the tests group as below."""
    names = ("completeness_score", "consistency_score", "accuracy_score", "timeliness_score", "uniqueness_score",
             "validity_score", "overall_quality_score")
    ok = col(names[0]).isNull()
    for here, after in zip(names, names[1:]):
        ok = ok | (_range(here, 0, 100) & col(after).isNull())
    return ok | _range(names[-1], 0, 100)


def metric_checks(df: DataFrame) -> DataFrame:
    counts = (col("total_records") >= 0)
    for c in ("valid_records", "invalid_records", "duplicate_records"):
        counts = counts & (col(c).isNull() | (col(c) >= 0))
    return check_rows(df, col("metric_id"), {
        "chk_quality_scores": ("overall_quality_score", _score_check()),
        "chk_quality_grade": ("quality_grade", _in("quality_grade", QUALITY_GRADES)),
        "chk_record_counts": ("total_records", counts),
    })


def violation_log_checks(df: DataFrame) -> DataFrame:
    return check_rows(df, col("violation_id"), {
        "chk_severity": ("severity_level", _in("severity_level", SEVERITIES)),
        "chk_violation_status": ("status", _in("status", VIOLATION_STATUS)),
        "chk_entity_type": ("entity_type", _in("entity_type", ENTITY_TYPES)),
    })


def key_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Primary keys, uniqueness, required columns and references of the star schema."""
    p, f, a, m = (tables[k] for k in ("providers", "facilities", "affiliations", "activities"))
    parts = [
        unique_violations(p, "pk_provider", ("provider_id",)),
        unique_violations(p, "uq_npi", ("npi_number",)),
        unique_violations(f, "pk_facility", ("facility_id",)),
        unique_violations(m, "pk_activity", ("activity_id",)),
        not_null_violations(p, "provider_id", ("full_name", "first_name", "last_name")),
        not_null_violations(f, "facility_id", ("facility_name",)),
        foreign_key_violations(a, "fk_affiliation_provider", "facility_id", "provider_id", p, "provider_id"),
        foreign_key_violations(a, "fk_affiliation_facility", "provider_id", "facility_id", f, "facility_id"),
        foreign_key_violations(m, "fk_activity_provider", "activity_id", "provider_id", p, "provider_id"),
        foreign_key_violations(m, "fk_activity_facility", "activity_id", "facility_id", f, "facility_id"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
