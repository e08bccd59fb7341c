"""Distinct values of the scores are counted on rows dealt out by content, not in the scan's own task."""

from cohortlens.operators import scores as S


def test_rows_are_dealt_out_before_distinct_values_are_counted(spark, capsys):
    df = spark.createDataFrame([(i, f"n{i % 7}", None if i % 3 else f"e{i}") for i in range(60)], "provider_id int, npi_number string, email string")
    out = S.uniqueness(df)
    assert abs(out.first()["uniqueness"] - round((100 + 700 / 60 + 100) / 3, 2)) < 0.011
    out.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_COL" in plan and plan.index("Expand") < plan.index("REPARTITION_BY_COL")
