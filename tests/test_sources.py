"""Category folders, inventories, copies and exports on small files."""

import datetime as dt

from pyspark.sql import functions as F

from cohortlens.operators import master as M
from cohortlens.sources import tables as IO


def _write(base, category, name, text):
    d = base / category
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{name}.csv").write_text(text)


def test_category_tables(spark, tmp_path):
    _write(tmp_path, "8_risk_factors", "heart_disease", ' Date ,Sample Size,Severe\n2020-03-01,"patients: 10; studies: 2",OR: 2.1\nbad,,\n,,\n')
    _write(tmp_path, "6_diagnostics", "pcr", 'Date,Journal\n3/5/2020,"Line one\nline two"\n')
    _write(tmp_path, "6_diagnostics", "empty", "")
    _write(tmp_path, "9_other", "ignored", "a\n1\n")
    rows = IO.read_category_tables(spark, str(tmp_path))
    assert rows.count() == 4
    assert {(r.source_category, r.source_table) for r in rows.collect()} == {("8_risk_factors", "heart_disease"), ("6_diagnostics", "pcr")}
    assert rows.where("Journal is not null").first().Journal == "Line one\nline two"
    risk = IO.unify(rows, "risk")
    assert risk.columns[:3] == ["date", "sample_size", "severe"] or "sample_size" in risk.columns
    got = {r.risk_factor_type for r in risk.collect()}
    assert got == {"Heart Disease"}
    assert [r.date for r in IO.unify(rows, "diagnostics").collect()] == [dt.datetime(2020, 3, 5)]
    cols = {(r.source_table, r.column_name) for r in IO.table_columns(spark, str(tmp_path)).collect()}
    assert ("heart_disease", "Date") in cols and ("pcr", "Journal") in cols


def test_ordinals_do_not_depend_on_splits(spark, tmp_path):
    rows = [f"{i},word{i}" for i in range(3000)]
    for i, cut in enumerate((rows[:1000], rows[1000:1400], rows[1400:])):
        d = tmp_path / "8_risk_factors" / "age.csv"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"part-{i:05d}.csv").write_text("n,w\n" + "\n".join(cut) + "\n")
    _write(tmp_path, "6_diagnostics", "pcr", "n,w\n7,x\n8,y\n")
    _write(tmp_path, "6_diagnostics", "other", "w,z\na,b\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("134217728", "9000", "2500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = IO.read_category_tables(spark, str(tmp_path), multi_line=False)
            seen.append(sorted((r.source_table, r.row_ordinal, r.n or "", r.w) for r in got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2]
    assert [(o, n) for t, o, n, _ in seen[0] if t == "age"] == [(i, str(i)) for i in range(3000)]
    assert [(t, o, n) for t, o, n, _ in seen[0] if t != "age"] == [("other", 0, ""), ("pcr", 0, "7"), ("pcr", 1, "8")]


def test_headers_with_any_name(spark, tmp_path):
    _write(tmp_path, "8_risk_factors", "a", "Rate (95% C.I.),_path,x`y\n1.5,p,q\n")
    _write(tmp_path, "8_risk_factors", "b", "Rate (95% C.I.)\n2\n")
    got = IO.read_category_tables(spark, str(tmp_path)).toDF("rate", "path", "tick", "c", "t", "o").orderBy("t").collect()
    assert [(r.rate, r.path, r.tick, r.t, r.o) for r in got] == [("1.5", "p", "q", "a", 0), ("2", None, None, "b", 0)]


def test_standardize_drops_empty_rows_and_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-02", "a"), ("nonsense", "b"), (None, None)], "`Study Date ` string, ` Some Name` string")
    out = IO.standardize(df).orderBy("some_name").collect()
    assert [(r.study_date, r.some_name) for r in out] == [(dt.datetime(2020, 1, 2), "a"), (None, "b")]


def test_inventory(spark, tmp_path):
    for c in ("1_population", "3_patient_descriptions", "6_diagnostics", "8_risk_factors"):
        _write(tmp_path, c, "t", "a\n1\n")
    _write(tmp_path, "8_risk_factors", "u", "a\n1\n")
    got = {r.category: r for r in IO.input_inventory(spark, str(tmp_path)).collect()}
    assert got["8_risk_factors"].files == 2 and not got["5_materials"].found and all(r.usable for r in got.values())


def test_copy_detects_no_difference_and_sample_is_stable(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    assert IO.copy_and_reconcile(df, str(tmp_path / "copy")).first().matches
    a = [r.id for r in IO.sample_rows(df, "id", 50).collect()]
    b = [r.id for r in IO.sample_rows(df.repartition(7), "id", 50).collect()]
    assert a == b and len(set(a)) == 50


def test_authors_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("author_id,authors\nx 1,\"Doe, Jane\"\n,\"Van Der Berg, Ann Marie\"\n")
    p = M.authors_to_providers(IO.read_authors(spark, str(tmp_path / "a.csv")).withColumns(
        {"license_state": F.lit("CA"), "birth_year": F.lit(1990)})).orderBy("provider_id").collect()
    assert [r.provider_id for r in p] == ["PROV_000001", "PROV_x_1"]
    assert (p[1].first_name, p[1].last_name, p[1].middle_initial) == ("Doe", "Jane", None)
    assert (p[0].first_name, p[0].last_name, p[0].middle_initial) == ("Van", "Marie", "D")
    assert len(p[0].npi_number) == 10 and p[0].npi_number.isdigit()


def test_change_capture_and_apply_round_trip(spark):
    old = spark.createDataFrame([("1", "a", None), ("2", "b", "x"), ("3", "c", "y")], "id string, name string, note string")
    new = spark.createDataFrame([("1", "a", None), ("2", "b", None), ("4", "d", "z")], "id string, name string, note string")
    ch = M.capture_changes(old, new, "id")
    got = {r.record_id: r for r in ch.collect()}
    assert {k: v.operation_type for k, v in got.items()} == {"2": "UPDATE", "3": "DELETE", "4": "INSERT"}
    assert got["2"].changed_columns == {"note": None} and got["2"].before_values["note"] == "x"
    flat = ch.select("record_id", "operation_type", F.lit(1).alias("n"), *[F.element_at("after_values", c).alias(c) for c in ("name", "note")])
    out = M.apply_changes(old, flat, "id", ["n"], ["name", "note"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in new.collect())
