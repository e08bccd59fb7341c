"""Exact dedup, line dedup and SimHash against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup, line_dedup, simhash

from .conftest import ROWS


def brute_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(g), i == best[2] and len(t or "") == -best[0], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("support", [1 / 1024, 0.4])
def test_exact(edge, support):
    got = [tuple(r) for r in exact_dedup.exact_dedup(edge, support=support).collect()]
    assert sorted(got, key=str) == brute_exact(ROWS)


def test_exact_hot(spark):
    rows = [(i, "hot text" if i % 3 == 0 else "warm" if i % 3 == 1 and i % 2 else f"text {i % 500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in exact_dedup.exact_dedup(df, support=0.01).collect()]
    assert sorted(got, key=str) == brute_exact(rows)


def brute_lines(docs, min_words):
    """Every run of lines in order of place; a line goes if a run over it has an earlier twin."""
    cut = {}
    for d, t in docs:
        raw, out = t.split("\n"), []
        for line in raw:
            if out and (not line.strip() or not out[-1].strip()):
                out[-1] += "\n" + line
            else:
                out.append(line)
        cut[d] = out
    first, gone = {}, defaultdict(set)
    runs = [(d, i, j) for d, ls in cut.items() for i in range(len(ls)) for j in range(i + 1, len(ls) + 1)]
    for d, i, j in sorted(runs):
        ls = [x.strip() for x in cut[d][i:j]]
        if any(not x for x in ls) or sum(len(x.split()) for x in ls) < min_words:
            continue
        if first.setdefault(tuple(ls), (d, i)) != (d, i):
            gone[d].update(range(i, j))
    return {d: "\n".join(x for n, x in enumerate(ls) if n not in gone[d]) for d, ls in cut.items()}, gone


@pytest.mark.parametrize(("min_words", "seed"), [(5, 1), (3, 2), (9, 3), (1, 4)])
def test_lines(spark, min_words, seed):
    r = random.Random(seed)
    some = ["", " ", "a", "b c", "d e f", "g h i j k l", "  m n ", "o"]
    docs = [(d, "\n".join(r.choice(some) for _ in range(r.randint(0, 12)))) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.text, x.n_deleted) for x in line_dedup.delete_repeated(df, min_words=min_words).select("row.doc_id", "text", "n_deleted").collect()}
    texts, gone = brute_lines(docs, min_words)
    assert got == {d: (texts[d], len(gone[d])) for d, _ in docs}


def test_lines_edge(edge, nothing):
    got = line_dedup.delete_repeated(edge).select("row.*", "n_deleted", F.col("text").alias("left")).collect()
    assert len(got) == len(ROWS) and got[0].__fields__[:14] == edge.columns
    by = {x.doc_id: x for x in got if x.doc_id in (2, 8, 9, 10)}
    assert by[8].left == by[8].text and by[9].left == "" and by[10].n_deleted == 0
    assert by[2].n_deleted == 1 and by[2].left.startswith("One  text")  # blanks inside a line count
    assert line_dedup.delete_repeated(nothing).count() == 0


def fingerprint(t):
    w = (t or "").encode().lower().split()
    k = min(4, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(ids, fps):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    comp = np.array(ids)
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(comp))])
        if (new == comp).all():
            return dict(zip(ids, comp.tolist(), strict=True))
        comp = new


@pytest.mark.parametrize("group", [2048, 3])
def test_simhash_links(spark, group):
    """Chains and stars of fingerprints; with small groups also by the path for large ones."""
    r = random.Random(5)
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    fps = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            x = flip(x, r.randint(1, 6))
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [tuple(e) for e in simhash.links(df, group).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in edges)
    want, top = components(list(range(len(fps))), fps), {s: i for i, s in enumerate(signed)}
    comp = list(range(len(fps)))
    for _ in fps:
        for a, b in edges:
            comp[top[a]] = comp[top[b]] = min(comp[top[a]], comp[top[b]])
    assert dict(enumerate(comp)) == want


def test_simhash_edge(edge, nothing):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(ROWS)
    shown = sorted((str(x.doc_id), x.fp % (1 << 64)) for x in got)
    assert shown == sorted((str(i), fingerprint(t)) for i, t in ROWS)
    comp = {(x.doc_id, x.fp): x.component_id for x in got}
    assert {c for (_, f), c in comp.items() if f == 0} == {3}
    assert [c for (i, _), c in comp.items() if i == 9] == [8]
    assert simhash.representatives(edge).count() == len({x.root for x in got})
    assert simhash.near_duplicates(nothing).count() == 0
