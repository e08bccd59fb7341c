"""Hand-made rows for the branches and quirks of the rules and scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import predicates as P
from cohortlens.operators import records, rules, scores
from cohortlens.plans import runner

ASOF = dt.date(2025, 1, 1)
COLS = ("provider_id string, npi_number string, full_name string, first_name string, last_name string, email string, phone_number string, "
        "birth_year int, graduation_year int, years_in_practice int, license_expiry_date date, record_status string, license_state string, "
        "last_updated date")


def provider(pid="P1", npi="1234567890", full="Ann Lee", first="Ann", last="Lee", email="ann@clinic.org", phone="555-123-4567", birth=1970,
             grad=1996, years=20, expiry=dt.date(2027, 1, 1), status="ACTIVE", state="CA", updated=dt.date(2024, 12, 1)):
    return (pid, npi, full, first, last, email, phone, birth, grad, years, expiry, status, state, updated)


@pytest.fixture()
def tables(spark):
    def make(providers, affiliations=(), facilities=(("F1", "Clinic"),)):
        return {
            "providers": spark.createDataFrame(providers, COLS),
            "affiliations": spark.createDataFrame(list(affiliations), "provider_id string, facility_id string, is_primary_affiliation boolean, end_date date"),
            "facilities": spark.createDataFrame(list(facilities), "facility_id string, facility_name string"),
        }

    return make


def severities(df, key="provider_id"):
    return {r[key]: (r["severity"], r["issue_description"]) for r in df.collect()}


def test_clean_provider_has_no_violation(tables):
    t = tables([provider()], [("P1", "F1", True, None)])
    for name in ("provider_name_inconsistency", "npi_validation", "affiliation_anomaly", "temporal_consistency", "contact_validation",
                 "cross_reference_integrity"):
        for v in ("standard", "optimized"):
            assert rules.RULES[name](t, variant=v, asof=ASOF).count() == 0, (name, v)


def test_name_rule_wildcards_backslash_and_case(tables):
    t = tables([
        provider("P1", full="ann lee"), provider("P2", full="Axn Lee", first="A_n"), provider("P3", full="a\\b Lee", first="a\\b"),
        provider("P4", full=None), provider("P5", full="Zed", first=None, last=None), provider("P6", full="TEST Ann Lee"),
        provider("P7", full="Bob Lee"), provider("P8", full="a%c Lee", first="a%c"), provider("P9", full="abLee", first="a%x")])
    got = severities(rules.provider_name_inconsistency(t))
    assert set(got) == {"P4", "P5", "P6", "P7", "P9"}
    assert got["P4"][0] == "CRITICAL" and got["P5"][0] == "HIGH" and got["P6"][0] == "LOW" and got["P7"][0] == "MEDIUM"
    opt = severities(rules.provider_name_inconsistency(t, "optimized"))
    assert opt["P7"][1] == "First name inconsistency" and opt["P6"][1] == "Suspicious test data detected"


def test_text_severity_order(tables):
    t = tables([provider("P1", full=None), provider("P2", full="Bob Lee"), provider("P3", full="TEST Ann Lee"), provider("P4", full="Z", first=None, last=None)])
    assert [r.severity for r in rules.provider_name_inconsistency(t).collect()] == ["MEDIUM", "LOW", "HIGH", "CRITICAL"]
    assert [r.severity for r in rules.provider_name_inconsistency(t, "optimized").collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_npi_rule_branches(tables):
    t = tables([provider("P1", npi=None), provider("P2", npi="123"), provider("P3", npi="12345678x0"), provider("P4", npi="1111111111"),
                provider("P5", npi="1111111111", status="INACTIVE"), provider("P6", npi="x234567890"), provider("P7", npi="1234567890\n")])
    std = severities(rules.npi_validation(t))
    assert "P1" not in std  # removed before the missing test
    assert std["P3"] == ("MEDIUM", "Invalid NPI format (must be numeric)") and std["P6"][0] == "HIGH"
    assert std["P4"][1] == std["P5"][1] == "Duplicate NPI detected" and std["P7"][1].startswith("Invalid NPI length")
    opt = severities(rules.npi_validation(t, "optimized"))
    assert opt["P1"] == ("CRITICAL", "Missing NPI number") and "P5" not in opt
    assert opt["P4"][1] == "Duplicate NPI detected (2 occurrences)"  # counted over all statuses


def test_affiliation_variants_differ_on_single_ended(tables):
    ended = dt.date(2024, 1, 1)
    t = tables([provider("P1"), provider("P2"), provider("P3")],
               [("P1", "F1", True, ended), ("P2", "F1", True, None), ("P2", "F2", True, None), ("P3", "F1", False, None)])
    assert set(severities(rules.affiliation_anomaly(t))) == {"P1", "P2", "P3"}
    opt = severities(rules.affiliation_anomaly(t, "optimized"))
    assert set(opt) == {"P2", "P3"} and opt["P2"][1].endswith("(2)")


def test_temporal_variants(tables):
    t = tables([provider("P1", birth=1915), provider("P2", grad=1980), provider("P3", years=45), provider("P4", expiry=dt.date(2024, 1, 1)),
                provider("P5", birth=None, years=-1), provider("P6", expiry=dt.date(2036, 1, 1)), provider("P7", grad=None, years=40)])
    std = severities(rules.temporal_consistency(t, asof=ASOF))
    assert std["P1"][1] == "Unrealistic birth year" and std["P2"][1] == "Graduation before reasonable age"
    assert std["P3"][1] == "Years in practice exceeds possible time" and std["P4"][0] == "CRITICAL" and "P5" not in std
    assert std["P6"][1] == "License expiry too far in future" and std["P7"] == ("MEDIUM", "Other temporal inconsistency")
    assert "P3" not in severities(rules.temporal_consistency(t, "optimized", ASOF))


def test_cross_reference_kinds(tables):
    t = tables([provider("P1"), provider("P2"), provider("P3", status="INACTIVE")],
               [("P1", "F1", True, None), ("PX", "F1", True, None), ("PX", "F9", True, None), (None, "F1", True, None)], [("F1", "A"), ("F2", None)])
    got = sorted((r.entity_type, r.entity_id) for r in rules.cross_reference_integrity(t).collect())
    assert got == [("affiliation_missing_facility", "F9"), ("affiliation_missing_provider", "PX"), ("affiliation_missing_provider", "PX"),
                   ("affiliation_missing_provider", "unknown"), ("facility_no_providers", "F2"), ("provider_no_affiliations", "P2")]


def test_contact_dead_branches(tables):
    t = tables([provider("P1", email=None), provider("P2", email="same@x.org"), provider("P3", email="same@x.org"), provider("P4", phone="(555) 123-4567"),
                provider("P5", email=None, phone=None), provider("P6", email="a@example.org")])
    std = severities(rules.contact_validation(t))
    assert "P1" not in std and std["P2"][1] == "Duplicate email address" and std["P4"][1] == "Invalid phone number format"
    opt = severities(rules.contact_validation(t, "optimized"))
    assert "P2" not in opt and opt["P5"] == ("CRITICAL", "Missing both email and phone") and opt["P6"] == ("LOW", "Test/dummy email detected")


def test_failing_rule_is_isolated(tables):
    def broken(tables, variant, asof, **_):
        return tables["providers"].select("no_such_column")

    t = tables([provider(full=None)])
    out = runner.run_rules(t, ASOF, rules={"broken": broken, **rules.RULES}, disabled=("npi_validation",))
    got = {r.rule_name for r in out.collect()}
    assert "npi_validation" not in got and "provider_name_inconsistency" in got
    assert [r.severity for r in out.where("rule_name = 'broken'").collect()] == ["ERROR"]


def test_failing_rule_at_run_time_is_isolated(tables, tmp_path):
    def fails(tables, variant, asof, **_):
        return tables["providers"].select(F.lit("fails").alias("rule_name"), "provider_id", F.raise_error(F.lit("boom")).cast("string").alias("issue_description"),
                                          F.lit("LOW").alias("severity"))

    t = tables([provider(full=None)])
    out = runner.run_rules_to(t, str(tmp_path / "out"), ASOF, rules={"fails": fails, "provider_name_inconsistency": rules.provider_name_inconsistency})
    assert {(r.rule_name, r.severity) for r in out.collect()} == {("fails", "ERROR"), ("provider_name_inconsistency", "CRITICAL")}


def test_severity_counts_add_up(tables):
    t = tables([provider(f"P{i}", full=None if i % 2 else "TEST", npi=None if i % 3 else "12") for i in range(12)])
    v = runner.run_rules(t, ASOF, "optimized")
    assert sum(r.violations for r in runner.run_summary(v).collect()) == v.count()


def test_scores_on_small_frames(spark):
    one = lambda df: df.first()[0]
    df = spark.createDataFrame([(None, "x"), (None, "y"), (None, "z"), (None, "w")], "all_null string, some_data string")
    assert one(scores.completeness(df)) == 50.0
    empty = spark.createDataFrame([], "email string, last_updated date")
    assert one(scores.completeness(empty)) == 0.0 and one(scores.accuracy(empty, ASOF)) == 100.0 and one(scores.timeliness(empty, asof=ASOF)) == 100.0
    assert one(scores.completeness(df, ["some_data", "absent"])) == 50.0
    nulls = spark.createDataFrame([(None,)], "last_updated date")
    assert one(scores.timeliness(nulls, asof=ASOF)) == 50.0
    old = spark.createDataFrame([(dt.date(2024, 1, 1),)], "last_updated date")
    assert one(scores.timeliness(old, asof=ASOF)) == 0.0
    dup = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert one(scores.uniqueness(dup, ["none_of_these"])) == 66.67


def test_outlier_flags_only_the_far_value(spark):
    df = spark.createDataFrame([(v,) for v in [*range(1, 10), 100]], "values long")
    assert [r[0] for r in scores.outlier_flag(df, "values").where("is_outlier").collect()] == [100]


def test_zero_counts_as_unfilled_for_providers_only(spark):
    df = spark.createDataFrame([("Ann Lee", "Ann", "Lee", "Surgery", "L1", "CA", "1234567890", "a@b.org", "555-123-4567", 0)],
                               "full_name string, first_name string, last_name string, specialty_primary string, license_number string, license_state string, "
                               "npi_number string, email string, phone_number string, years_in_practice int")
    assert records.provider_overall(df).first()["completeness_score"] == pytest.approx(70 + 30 * 3 / 5)


def test_predicates_propagate_null(spark):
    df = spark.createDataFrame([(None, "a"), ("abc", None), ("ABC", "b")], "w string, p string")
    got = [r[0] for r in df.select(P.contains_ci(F.col("w"), F.col("p"))).collect()]
    assert got == [None, None, True]


def test_orphans_of_repeated_missing_and_null_keys(spark):
    from pyspark.sql import functions as F

    a = spark.createDataFrame([("p1", "f1"), ("p9", "f1"), ("p9", "f9"), (None, "f1"), ("p2", None)], "provider_id string, facility_id string")
    a = a.unionByName(spark.range(25_000).select(F.lit("hot").alias("provider_id"), F.lit("f1").alias("facility_id")))
    p = spark.createDataFrame([("p1", "A", "ACTIVE"), ("p2", "B", "ACTIVE"), ("p3", None, "ACTIVE"), ("p3", "C", "ACTIVE"), ("p4", "D", "INACTIVE"), (None, "N", "ACTIVE")],
                              "provider_id string, full_name string, record_status string")
    f = spark.createDataFrame([("f1", "X"), ("f2", "Y")], "facility_id string, facility_name string")
    rows = rules.orphan_rows({"affiliations": a, "providers": p, "facilities": f})
    got = {tuple(r)[:3]: r["count"] for r in rows.groupBy(*rows.columns).count().collect()}
    assert got == {
        ("affiliation_missing_provider", "p9", "Provider ID: p9"): 2, ("affiliation_missing_provider", None, None): 1,
        ("affiliation_missing_provider", "hot", "Provider ID: hot"): 25_000, ("affiliation_missing_facility", "f9", "Facility ID: f9"): 1,
        ("affiliation_missing_facility", None, None): 1, ("provider_no_affiliations", "p3", "Provider: p3"): 1, ("provider_no_affiliations", "p3", "Provider: C"): 1,
        ("provider_no_affiliations", None, "Provider: N"): 1, ("facility_no_providers", "f2", "Facility: Y"): 1}
    plan = rules.cross_reference_integrity({"affiliations": a, "providers": p, "facilities": f}, "optimized")
    assert plan.count() == 1000 + 2 + 3 + 1
