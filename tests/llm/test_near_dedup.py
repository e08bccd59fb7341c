"""The pipeline's near-dedup stage against brute force: one document of each SimHash component stays."""

import random

import pytest

import corpus_pipeline
from cohortlens.llm import simhash

from .conftest import ROWS
from .test_dedup import components, fingerprint


def copies(seed):
    """Groups of copies with a few replaced words, exact copies, and unlike texts around one passage."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    texts, passage = [], [word() for _ in range(30)]
    for n in [3, 6, 60, 200, 400, 1500]:
        base = [word() for _ in range(n)]
        for _ in range(10):
            copy = list(base)
            for _ in range(r.randint(0, max(1, n // 60))):
                copy[r.randrange(n)] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(r.randint(1, 40))] for _ in range(40)]
    r.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_stage(spark, seed):
    docs = copies(seed)
    comp = components([i for i, _ in docs], [fingerprint(t) for _, t in docs])
    df = spark.createDataFrame([(i, t, str(i), i) for i, t in docs], "doc_id long, text string, fp string, root long").repartition(5)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    rows = got.collect()
    assert {x.doc_id for x in rows} == set(comp.values()) and len(rows) == len(set(comp.values())) < len(docs)
    texts = dict(docs)
    assert all(x.text == texts[x.doc_id] and x.fp == str(x.doc_id) and x.root == x.doc_id for x in rows)


def test_stage_edge(spark, edge, nothing):
    got = corpus_pipeline.near_dedup(spark, edge, "")
    assert got.columns == edge.columns
    kept = {(x.doc_id, x.text) for x in got.collect()}
    assert kept <= set(ROWS)
    # Of null, empty and blank texts the smallest id stays, of copies the smaller one; a row repeated in full shares its fate.
    assert [i for i, t in kept if not (t or "").strip()] == [3]
    assert 8 in {i for i, _ in kept} and 9 not in {i for i, _ in kept}
    assert got.where("doc_id = 6").count() == 2
    assert corpus_pipeline.near_dedup(spark, nothing, "").count() == 0


def test_lines_without_counts(spark):
    """Line dedup asks for no other column than id and text, and leaves other columns as they are."""
    df = spark.createDataFrame([(1, "a line of five words here", "r"), (2, "a line of five words here\nmore", "s")], "doc_id long, text string, row string")
    got = corpus_pipeline.dedup_lines(spark, df, "")
    assert sorted(map(tuple, got.collect())) == [(1, "a line of five words here", "r"), (2, "more", "s")]


@pytest.mark.parametrize("spots", [64, simhash.SPOTS])
def test_only_members_of_groups_are_joined(spark, spots):
    """A bit table keeps rows without a group out of the join; a table that is too small lets more rows through and loses none."""
    keyed = spark.range(6000).selectExpr("cast(id % 3 as int) c", "id * 7919 % 3000 key", "id fp")
    groups = spark.range(40).selectExpr("cast(id % 3 as int) c", "id * 7919 % 3000 key", "id + 3 n")
    got = simhash.in_groups(keyed, groups, spots)
    want = keyed.join(groups, ["c", "key"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_links_shuffle_few_rows_for_members(spark, monkeypatch):
    """Fingerprints whose bits no other shares are not dealt out a second time."""
    r, real, plans = random.Random(3), simhash.stored, {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = [r.getrandbits(64) for _ in range(2000)]
    values += [values[0] ^ (1 << b) for b in (3, 30, 60)]
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.update({name: df}) or real(df, name))
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in values], "fp long")).collect()
    assert {x for e in edges for x in e} == {signed(x) for x in [values[0], *values[-3:]]}
    plan = plans["simhash-members"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "rightHint=(strategy=broadcast)" in plan
