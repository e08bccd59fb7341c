"""Registered queries against their SQL, and the pipeline against what its stages promise."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.fixtures import DRIVER_TABLES
from cohortlens.llm import queries
from cohortlens.session import stored
from tools.check_sql import rows

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cur = duck.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    edge = spark.createDataFrame([(10**6, None, "en", "x", None), (10**6 + 1, "123 456", None, None, 7), (None, "The and of this text in with that on.", None, None, 1)], docs.schema)
    whole = docs.unionByName(edge)
    after = [whole]
    for name, stage in corpus_pipeline.STAGES:
        after.append(stored(stage(spark, after[-1], FOLDER), name))
        if name != "bpe":
            assert after[-1].columns == docs.columns
    n = [x.count() for x in after]
    assert n[0] >= n[1] >= n[2] >= n[3] >= n[4] == n[5] > 0
    gone = {x.doc_id for x in whole.select("doc_id").subtract(after[1].select("doc_id")).collect()}
    assert gone == {10**6, 10**6 + 1}  # clean documents stay
    kept = {x.doc_id: x.text for x in after[4].collect()}
    assert {x.doc_id: x.text for x in after[5].collect()} == kept
    texts = list(kept.values())
    assert len(set(texts)) == len(texts)
    items = [x.text for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not [i for i in items if any(i in t for t in texts)]


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0
