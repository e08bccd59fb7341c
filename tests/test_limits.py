"""Things that once were cut: long ids, deep JSON, later micro-batches, long chains, rule limits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.fixtures import VIEWS
from cohortlens.operators import graph, master, monitoring, rules, survival, text
from cohortlens.plans import runner
from cohortlens.session import scratch_path
from cohortlens.streaming import jobs

NUMBERS = (7, 999_999, 1_050_000, 10_000_000, 8_589_934_592, 8_589_934_593)


def test_long_ids_stay_apart(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    assert [r[0] for r in df.select(master.padded(F.col("n"))).collect()] == [f"{n:06d}" for n in NUMBERS]


def test_long_ids_in_views(spark):
    text_ = VIEWS["change_log"]
    rows = [(i, n, "signup") for i, n in enumerate(NUMBERS)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.current_timestamp())
    want = sorted(f"PROV_{n:06d}" for n in NUMBERS)
    assert sorted(r.record_id for r in spark.sql(text_, events=events).collect()) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, n AS user_id, 'signup' AS event_type, now() AS ts FROM (SELECT unnest(range(6)) AS i, unnest($1) AS n)", [list(NUMBERS)])
    assert sorted(r[0] for r in con.execute(f"SELECT record_id FROM ({text_.format(events='events')})").fetchall()) == want


def test_deep_json(spark):
    rows = [(1, '{"a":{"b":{"c":{"d":{"e":{"f":5}}}}},"x":{}}'), (2, '{"a":1,"l":[1,3],"s":"{no object"}'), (3, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {(r.id, r.name, r.value) for r in monitoring.flatten_json_metrics(df, "j", ["id"]).collect()}
    assert got == {(1, "a.b.c.d.e.f", 5.0), (2, "a", 1.0), (2, "l.avg", 2.0), (2, "l.max", 3.0), (2, "l.min", 1.0)}


def test_change_stream_of_two_batches(spark):
    base = scratch_path(spark, "two")
    start = spark.createDataFrame([("P1", "a"), ("P2", "b")], "provider_id string, email string")
    schema = "record_id string, operation_type string, email string, n long"
    for i, row in enumerate([("P1", "UPDATE", "first", 1), ("P1", "UPDATE", "second", 2)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{base}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    out = jobs.apply_change_stream(stream, f"{base}/table", start, "provider_id", ["n"], ["email"], f"{base}/checkpoint")
    assert {tuple(r) for r in out.select("provider_id", "email").collect()} == {("P1", "second"), ("P2", "b")}


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(edges)
    assert got.count() == 301 and got.select("component").distinct().count() == 1


def test_communities_settle(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    edges = spark.createDataFrame([*cliques, (4, 10)], "src long, dst long")
    got = {r.node: r.community for r in graph.communities(edges).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(11, 15)}) == 1


@pytest.mark.parametrize("limits", [True, False])
def test_rule_limits_can_be_lifted(spark, limits):
    n = 1200
    providers = spark.range(n).select(F.concat(F.lit("P"), "id").alias("provider_id"), F.lit("x").alias("full_name"))
    aff = spark.range(n).select(F.concat(F.lit("P"), "id").alias("provider_id"), F.lit("F").alias("facility_id"), F.lit(False).alias("is_primary_affiliation"), F.lit(None).cast("date").alias("end_date"))
    t = {"providers": providers, "affiliations": aff}
    out = runner.run_rules(t, None, only=["affiliation_anomaly"], limits=limits)
    assert out.count() == (1000 if limits else n)


def test_rule_run_sorts_nothing(spark):
    """No range partitioning in a run of all rules."""
    from cohortlens.plans.registry import Tables
    from cohortlens.fixtures import ASOF

    t = Tables(spark, "/root/testdata/sf0.001").pick("providers", "facilities", "affiliations")
    plan = runner.run_rules(t, ASOF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert rules.affiliation_anomaly(t, limit=None, ordered=False).count() > 0


def test_words_with_digits(spark):
    df = spark.createDataFrame([(1, "covid-19 a 5g the 5g"), (2, "ab")], "id int, t string")
    assert [r.tokens for r in text.word_tokens(df, "t", ["id"]).orderBy("id").collect()] == [["covid", "19", "5g", "5g"], ["ab"]]


def test_logrank_of_many_groups(spark):
    """70 groups; the pairs agree with the test of two groups alone."""
    df = spark.range(2100).select((F.col("id") % 70).cast("int").alias("g"), (1 + F.col("id") * 37 % 23).cast("int").alias("t"), ((F.col("id") * 11) % 3 > 0).cast("int").alias("e"))
    got = {r.test: r for r in survival.logrank(df, "t", "e", "g").collect()}
    assert len(got) == 70 * 69 // 2 + 1
    alone = survival.logrank(df.where("g in (3, 41)"), "t", "e", "g").first()
    assert abs(got["3_vs_41"].statistic - alone.statistic) < 1e-9 and 0 <= got["multivariate"].p_value <= 1
    assert survival.logrank(df.where("false"), "t", "e", "g").count() == 0


def test_checkpoint_folder_on_a_cluster_must_be_shared():
    from cohortlens.session import own_folder

    assert own_folder("local[8]", "file:/tmp/w/") == "file:/tmp/w/_checkpoints"
    assert own_folder("spark://host:7077", "hdfs://name/w") == "hdfs://name/w/_checkpoints"
    for warehouse in ("file:/tmp/w", "/tmp/w", "file:///tmp/w"):
        with pytest.raises(ValueError):
            own_folder("spark://host:7077", warehouse)
