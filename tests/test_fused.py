"""Rules in shared passes against the same rules planned one by one."""

import datetime as dt
from collections import Counter

import pytest

from cohortlens.fixtures import ASOF
from cohortlens.operators.rules import RULES
from cohortlens.plans import fused, runner
from cohortlens.plans.registry import Tables

FUSED = sorted(n for names, _ in fused.PASSES for n in names)


def one_by_one(tables, limits):
    parts = [runner.run_rules(tables, ASOF, only=[n], limits=limits) for n in RULES]
    return Counter(tuple(r) for p in parts for r in p.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, shared and odd NPIs and e-mails, keys without entities and entities without keys."""
    p = [("P1", "Ann Lee", "Ann", "Lee", "1234567890", "a@b.org", "5551234567", "ACTIVE", 1970, 1995, 20, "2030-01-01"),
         ("P2", "Test User", "Bob", None, "1234567890", "A@b.org", None, "INACTIVE", 1900, 1995, -2, "2001-01-01"),
         ("P3", None, None, None, "12x", "a@b.org", "12", None, 1980, 1985, 70, "no date"),
         ("P4", " ", "C", "D", None, None, "5551234567", "ACTIVE", None, None, None, None),
         ("P5", "Eve Fox", "Eve", "Fox", "123456789x", "nothing", "555-123-4567", "ACTIVE", 2020, 2050, 3, "2999-01-01"),
         (None, "No Id", "No", "Id", "", "", "", None, 1960, None, 60, None)]
    f = [("F1", "One"), ("F2", None), (None, "Nowhere")]
    day = dt.date(2020, 1, 1)
    a = [("P1", "F1", True, None), ("P1", "F1", True, day), ("P2", None, False, day), ("P3", "F9", True, day), ("P9", "F1", None, None), ("P9", "F1", True, None),
         (None, "F1", True, None), (None, None, None, None), *[("P5", "F1", i == 0, None) for i in range(12)]]
    make = spark.createDataFrame
    return {
        "providers": make(p, "provider_id string, full_name string, first_name string, last_name string, npi_number string, email string, phone_number string, "
                             "record_status string, birth_year int, graduation_year int, years_in_practice int, license_expiry_date string"),
        "facilities": make(f, "facility_id string, facility_name string"),
        "affiliations": make(a, "provider_id string, facility_id string, is_primary_affiliation boolean, end_date date")}


@pytest.mark.parametrize("limits", [True, False])
def test_same_rows_odd(odd, limits):
    got = Counter(tuple(r) for r in runner.run_rules(odd, ASOF, limits=limits).collect())
    assert got == one_by_one(odd, limits)
    assert set(FUSED) <= {r[0] for r in got} and "ERROR" not in {r[5] for r in got}


def test_known_provider_without_status_is_no_orphan(odd):
    got = {(r.entity_type, r.entity_id) for r in RULES["cross_reference_integrity"](odd).collect()}
    assert ("affiliation_missing_provider", "P3") not in got and ("affiliation_missing_provider", "P9") in got


def test_empty(odd):
    none = {n: d.where("false") for n, d in odd.items()}
    assert [r.rule_name for r in runner.run_rules(none, ASOF, limits=False).collect()] == ["validation_summary"]


def test_same_rows_and_fewer_scans(spark):
    t = Tables(spark, "/root/testdata/sf0.001").pick("providers", "facilities", "affiliations")
    got = runner.run_rules(t, ASOF, limits=False)
    assert Counter(tuple(r) for r in got.collect()) == one_by_one(t, False)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    alone = sum(scans(runner.run_rules(t, ASOF, only=[n], limits=False)) for n in RULES)
    print(scans(got), scans(runner.run_rules(t, ASOF)), alone)
    assert scans(got) < 0.7 * alone


def test_a_pass_that_cannot_be_planned(odd):
    """Without facilities the rules of the third pass are planned alone: one of them fails, the other goes on."""
    got = runner.run_rules({n: d for n, d in odd.items() if n != "facilities"}, ASOF, limits=False)
    by = {(r.rule_name, r.severity == "ERROR") for r in got.select("rule_name", "severity").distinct().collect()}
    assert ("cross_reference_integrity", True) in by and ("affiliation_anomaly", False) in by and ("npi_validation", False) in by
