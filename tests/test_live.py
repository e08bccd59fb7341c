"""Queries on live rows find something of every kind they look for, and the SQL form of soundex agrees with Spark's."""

import duckdb
import pytest

from cohortlens.plans import catalog
from cohortlens.plans.queries_c_basics import soundex_sql

FOLDER = "/root/testdata/sf0.01"
NAMES = ["Smith", "Smyth", "Schultz", "Pfister", "Tymczak", "Ashcraft", "Ashcroft", "Hawley", "Honeyman", "Whoever", "Wwhite", "O'Brien", "Lee-Young",
         "Burroughs", "Lloyd", "Jackson", "Gutierrez", "Van Deusen", "a", "Bb", "Hhhh", "Müller", "Sq", "Rupert2", ""]


def test_soundex(spark):
    df = spark.createDataFrame([(n,) for n in NAMES if n] + [(None,)], "n string")
    want = {r.n: r.c for r in df.selectExpr("n", "soundex(n) AS c").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS n", [list(want)])
    assert dict(con.execute(f"SELECT n, {soundex_sql('n')} FROM t").fetchall()) == want


@pytest.mark.parametrize(("name", "column", "kinds"), [
    ("ck03b_activity_keys", "constraint_name", {"chk_activity_type", "chk_patient_count", "chk_citation_count", "chk_author_position"}),
    ("ck04b_employments", "constraint_name", {"chk_date_logic", "chk_employment_type", "chk_confidence_score", "unique_provider_facility_start"}),
    ("tx07d_gaps_in_notes", "gap_indicator", {"unclear", "future research", "needs further", "lack of evidence", "more studies needed", "not well understood"})])
def test_every_kind_is_found(spark, name, column, kinds):
    assert kinds <= {r[0] for r in catalog.queries()[name](spark, FOLDER).select(column).distinct().collect()}


@pytest.mark.parametrize("name", ["jn11b_misspelt_names", "er05b_institutional_names"])
def test_names_that_differ_are_linked(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert df.where("similarity BETWEEN 0.81 AND 0.99").count() > 0


def test_codes_of_misspelt_surnames_agree(spark):
    got = {r.last_name: r.code for r in catalog.queries()["sf05b_soundex_surnames"](spark, FOLDER).collect()}
    twins = [(n, n + n[-1]) for n in got if n + n[-1] in got]
    assert twins and all(got[a] == got[b] for a, b in twins) and len(set(got.values())) > 20
