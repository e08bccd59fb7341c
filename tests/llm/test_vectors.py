"""Whitening and exact top-k against numpy and brute force."""

import math
import random

import numpy as np
import pytest

from cohortlens.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row string, q string, score string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def whole(v, shift=0):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(1024 * float(np.float32(c))) + shift for c in v]


BAD = [(3, None), (200, [0.5, None, 0.1, 0.2]), (300, [0.5, float("nan"), 0.1, 0.2]), (5, [0.5, float("-inf"), 0.1, 0.2])]


@pytest.fixture(scope="module")
def some():
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(0, 1000, 10)]
    # Ties, a repeated row, an id with two vectors, a null id, a hot vector, a short one.
    rows += [(100, rows[10][1]), (100, rows[10][1]), (200, rows[3][1]), (None, rows[7][1]), (11, [0.1, 0.2])] + [(2000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(80)]
    return rows + BAD


def best(rows, k, every):
    x = [(i, w) for i, v in rows if (w := whole(v)) is not None]
    x = [(i, w + [0] * (4 - len(w))) for i, w in x]
    out = []
    for a, (i, v) in enumerate(x):
        if i is not None and i % every == 0:
            near = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j is None, j or 0, j) for b, (j, w) in enumerate(x) if b != a)
            out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(near[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [1, 3, 7])
def test_top_k(spark, some, bits, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 400)
    got = topk.top_k(table(spark, some), 10, 100, bits=bits).collect()
    assert sorted(str((r.query_id, r.rank, r.vec_id, r.score)) for r in got) == best(some, 10, 100)


def test_top_k_of_few(spark):
    assert topk.top_k(table(spark, [])).collect() == []
    assert topk.top_k(table(spark, [(100, [0.5])])).collect() == []
    assert topk.top_k(table(spark, BAD)).collect() == []
    got = topk.top_k(table(spark, [(100, [0.5]), (7, [-0.25]), (200, [])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(100, 1, 200, 0), (100, 2, 7, -512 * 256), (200, 1, 7, 0), (200, 2, 100, 0)]


def test_slices_hold_the_sums():
    r = np.random.default_rng(2)
    x = r.integers(-700, 700, (130, 5))
    block, q = topk.Block(x, 11), r.integers(-300, 300, 5)
    assert block.shift == 0
    got = sum(np.unpackbits(s.view(np.uint8), count=130, bitorder="little").astype(np.int64) << c for c, s in enumerate(block.scores(q)))
    assert (got - got.min() == x @ q - (x @ q).min()).all()


def check(got, rows, k, width):
    x = np.array([w + [whitening.SHIFT] * (width - len(w)) for _, v in rows if (w := whole(v, whitening.SHIFT)) is not None], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1], q[:, ::-1]
    assert len(got) == n * k
    want_dev = sorted(sum(int(c) ** 2 for c in r) for r in n * x - s)
    assert sorted(int(g.deviation) for g in got if g.component == 1) == want_dev
    for c in range(k):
        mine = [g for g in got if g.component == c + 1]
        assert {g.n for g in mine} == {n}
        assert mine[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and mine[0].identity_error < 1e-9
        w, v = sorted(g.whitened for g in mine), y @ q[:, c] / math.sqrt(values[c])
        assert np.allclose(w, sorted(v), atol=1e-7) or np.allclose(w, sorted(-v), atol=1e-7)


def test_whitening(spark, some):
    check(whitening.whiten(table(spark, some)).collect(), some, 4, 4)


def test_whitening_of_wide_vectors(spark):
    r = np.random.default_rng(3)
    scale = np.concatenate([[40.0, 9.0], np.linspace(1.3, 0.9, 58)])
    basis = np.linalg.qr(r.standard_normal((60, 60)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate((r.standard_normal((700, 60)) * scale) @ basis)]
    check(whitening.whiten(table(spark, rows)).collect(), rows, 8, 60)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, BAD)).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5])] * 3)).collect() == []
    flat = [(i, [0.5, i / 8, 0.25]) for i in range(9)]
    check(whitening.whiten(table(spark, flat)).collect(), flat, 1, 3)


def test_exact_deviations():
    y = np.array([[1 << 40, -(1 << 45), 3], [-7, 0, 5]])
    assert [int(d) for d in whitening.deviations(y)] == [sum(int(c) ** 2 for c in r) for r in y]
    y = np.array([[1 << 55, -(1 << 60)]])
    assert [int(d) for d in whitening.deviations(y)] == [(1 << 110) + (1 << 120)]
