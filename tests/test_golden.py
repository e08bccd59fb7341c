"""Golden records and matches by name and facility: what moves, and components against a search."""

import random

from cohortlens.operators import graph, master


def _sources(spark):
    kind = "provider_id string, full_name string"
    s1 = spark.createDataFrame([("p1", "Ann Barden"), ("p2", "Ann Barden"), ("p3", None), ("p4", "Bob Schuley"), ("p1", "Ann Barden")], kind)
    s2 = spark.createDataFrame([("q1", "ANN BARDEN"), ("q2", "Ann Barden"), ("q4", "Bob Schuley")], kind)
    a = spark.createDataFrame([("p1", "f1"), ("p1", "f1"), ("p2", "f2"), ("p2", None), ("q1", "f1"), ("q2", None), ("p4", "f4"), ("q4", "f5"), (None, "f1")],
                              "provider_id string, facility_id string")
    return s1, s2, a


def test_name_and_facility_groups_hold_both_sources(spark):
    got = sorted(tuple(r)[1:4] for r in master.institutional_matches(*_sources(spark)).collect())
    assert got == sorted([("Ann Barden~ANN BARDEN@f1", "source1", "p1"), ("Ann Barden~ANN BARDEN@f1", "source1", "p1"), ("Ann Barden~ANN BARDEN@f1", "source2", "q1"),
                          ("Ann Barden~Ann Barden", "source1", "p2"), ("Ann Barden~Ann Barden", "source2", "q2")])


def test_texts_of_keys_are_not_shuffled(spark):
    plan = master.institutional_matches(*_sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(match_key" not in plan


def test_keys_are_no_nodes(spark, monkeypatch):
    seen, find = [], master.connected_components
    monkeypatch.setattr(master, "connected_components", lambda e: (seen.append(e), find(e))[1])
    m = spark.createDataFrame([("A", "x", "source1", "p1"), ("A", "x", "source2", "p2"), ("B", "x", "source2", "p2"), ("B", "x", "source3", "p3"), ("B", "y", "source1", "p9")],
                              "match_type string, match_key string, source string, provider_id string")
    r = spark.createDataFrame([("source1", "p1", 1, 0.9), ("source2", "p2", 2, 0.8), ("source3", "p3", 3, 0.7), ("source1", "p9", 4, 0.9), ("source1", "p8", 5, 0.9)],
                              "source string, provider_id string, last_updated int, weight double")
    got = {x["golden_id"]: x["record_count"] for x in master.golden_records(m, r, ["weight"]).collect()}
    assert got == {"source1:p1": 3, "source1:p9": 1, "source1:p8": 1}
    assert all(n.startswith("source") for e in seen[0].collect() for n in e)


def test_components_of_paths_hubs_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"a{i:03}", f"a{i + 1:03}") for i in range(60)] + [("h50", f"h{i}") for i in range(10, 99)] + [("z", "z"), (None, "y"), ("b1", "b1"), ("b1", "b0")]
    edges += [(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(60)]
    root = {n: n for e in edges for n in e if n is not None}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {None: None, **{n: top(n) for n in root}}
