"""Embedding whitening: Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. One pass over the rows gives V Q for a block Q of some more vectors than
components are asked for: each task adds up ``YᵀYQ`` of its centred rows Y, and the tasks' sums are added by Spark.

1. A few Lanczos passes bound the spectrum from below.
2. A Chebyshev polynomial, built up by its three-term recurrence with one pass a degree, is small on the unwanted interval
   (from that bound to the least Ritz value of the block) and grows fast above it.
3. QR, then Rayleigh-Ritz on the filtered block. Leading Ritz pairs whose residual ``|Vq - eq|`` is at most ``TOL`` of the
   largest eigenvalue are certified and locked; the filter runs orthogonal to them. It ends when all wanted pairs are locked
   and no Ritz value of the rest lies above them; a run that can't certify raises an error.

Whole numbers are centred exactly, as ``n x - S`` with the per-dimension sums S, before they become doubles. What reaches the
driver, and is broadcast, is one number for each dimension and block vector (a few hundred kB at 1000 dimensions),
whatever the number of rows.

Defined results: vectors that are null or hold null or non-finite components are left out; shorter vectors count as filled
up with zero components; rows that repeat count, and are returned, each time; null ids stay; directions without variance
have no whitened value and are left out (so fewer than the asked components may come, and none if all vectors are equal);
of equal eigenvalues any basis of their space may come; the largest entry of an eigenvector is positive; an empty table gives no rows.
Components whose product with the number of rows exceeds 62 bits are an error. Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value
from cohortlens.llm.vectors import blocks, matrix, quantised
from cohortlens.session import stored

by_value(__name__)
col, lit = F.col, F.lit

#: Fixed value: added to each whole number.
SHIFT = 100_000
#: Largest residual of a certified pair, as a part of the largest eigenvalue, and the residual that a run at rest may end with.
TOL, AT_REST = 1e-14, 1e-11
#: Lanczos passes, degree at most, logarithm of the growth of the first against the last wanted vector in one filter.
LANCZOS, DEGREE, SPREAD = 10, 12, 23.0
ROUNDS = 300
BLOCK_BYTES = 16 << 20


def summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of ``of(x)``, a flat array for each block of rows; ``kind`` is long or double."""
    size = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in blocks(batches, size):
            part = of(matrix(batch["x"], width, SHIFT))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(add, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows, np.int64 if kind == "long" else np.float64)
    out[found["i"].to_numpy()] = found["v"].to_numpy()
    return out


class Covariance:
    """The covariance of the rows, known by its products with blocks of vectors."""

    def __init__(self, rows: DataFrame, n: int, width: int):
        self.rows, self.n, self.width = rows, n, width
        self.sums = summed(rows, width, lambda x: x.sum(axis=0), "long")
        largest = int(summed(rows, width, lambda x: np.array([int(np.abs(x).max(initial=0))]), "long")[0])
        if largest * n >= 1 << 62:
            raise OverflowError("n x may not fit 62 bits")
        n, s = self.n, self.sums
        self.trace = float(summed(rows, width, lambda x: np.array([(((n * x - s) / n) ** 2).sum()]), "double")[0]) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q, by one pass over the rows."""
        n, width, sent = self.n, self.width, self.rows.sparkSession.sparkContext.broadcast((self.sums, q))

        def part(x: np.ndarray) -> np.ndarray:
            s, q = sent.value
            y = (n * x - s) / n
            return (y.T @ (y @ q)).ravel()

        out = summed(self.rows, width, part, "double").reshape(q.shape) / n
        sent.destroy()
        return out

    def least(self, rng: np.random.Generator) -> float:
        """A cautious lower bound of the spectrum, by Lanczos."""
        q, before, beta = rng.standard_normal(self.width), np.zeros(self.width), 0.0
        q /= np.linalg.norm(q)
        basis, alphas, betas = [], [], []
        for _ in range(min(LANCZOS, self.width)):
            basis.append(q)
            v = self.times(q[:, None])[:, 0] - beta * before
            alphas.append(float(q @ v))
            v -= alphas[-1] * q
            for b in basis:
                v -= (b @ v) * b
            beta = float(np.linalg.norm(v))
            betas.append(beta)
            if beta <= 1e-12 * max(abs(a) for a in alphas):
                break
            before, q = q, v / beta
        t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - betas[-1])


def filtered(v: Covariance, x: np.ndarray, vx: np.ndarray, locked: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The block after the scaled Chebyshev recurrence that damps [low, cut]; ``vx`` is V X, which the last step has made."""
    apart = lambda y: y - locked @ (locked.T @ y)
    half, centre = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - centre)
    old, now = x, apart(vx - centre * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        old, now = now, apart(2 * (v.times(now) - centre * now) * (after / half) - sigma * after * old)
        sigma = after
    return now


def eigenpairs(v: Covariance, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns."""
    rng = np.random.default_rng(seed)
    k, size = min(k, v.width), min(v.width, max(3 * k, k + 16))
    x = np.linalg.qr(rng.standard_normal((v.width, size)))[0]
    low = v.least(rng) if size < v.width else 0.0
    locked, values = np.empty((v.width, 0)), np.empty(0)
    rest, still = np.inf, 0
    for _ in range(ROUNDS):
        vx = v.times(x)
        h = x.T @ vx
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        x, vx = x @ u, vx @ u
        off = vx - x * theta
        residual = np.linalg.norm(off - locked @ (locked.T @ off), axis=0)
        largest = max([*values, *theta, 0.0])
        if not largest:
            return np.empty(0), np.empty((v.width, 0))
        # Rounding sets a floor under the residual: a pair that rests there is as good as doubles give.
        still = still + 1 if residual[0] > rest / 2 else 0
        rest = residual[0]
        good = residual <= max(TOL * largest, rest * 2 if still >= 2 and rest <= AT_REST * largest else 0.0)
        n = int(np.argmin(good)) if not good.all() else len(good)
        if n:
            locked, values = np.concatenate([locked, x[:, :n]], axis=1), np.concatenate([values, theta[:n]])
            x, vx, theta, rest, still = x[:, n:], vx[:, n:], theta[n:], np.inf, 0
        order = np.argsort(-values, kind="stable")
        if len(values) >= k and (not len(theta) or theta[0] <= values[order[k - 1]] + TOL * largest):
            break
        if not len(theta):
            raise ArithmeticError("the block has no vectors left")
        top, want, cut = theta[0], theta[max(0, min(k - len(values), len(theta)) - 1)], theta[-1]
        floor = min(low, cut * 0.999)
        cut = max(cut, floor + 1e-8 * largest)
        grow = lambda t: float(np.arccosh(max(1.0, (2 * t - cut - floor) / (cut - floor))))  # noqa: E731, B023
        degree = int(np.clip(SPREAD / max(grow(top) - grow(want), 1e-3), 1, DEGREE))
        x = filtered(v, x, vx, locked, floor, cut, max(top, cut + 1e-8 * largest), degree)
        x = np.linalg.qr(x / np.maximum(np.linalg.norm(x, axis=0), 1e-300))[0]
        x = np.linalg.qr(x - locked @ (locked.T @ x))[0]
    else:
        raise ArithmeticError("eigenpairs are not certified")
    values, q = values[order[:k]], locked[:, order[:k]]
    has = values > v.width * np.finfo(float).eps * values[0]
    q, values = q[:, has], values[has]
    return values, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)


def deviations(y: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of the rows of whole numbers."""
    if y.size and max(int(y.max()), -int(y.min())) >= 1 << 50:
        return [Decimal(sum(int(c) * int(c) for c in r)) for r in y]
    high, low = y >> 24, y & 0xFFFFFF
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [Decimal((a << 48) + (b << 25) + c) for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


KIND = "component int, n long, deviation decimal(38,0), whitened double, eigenvalue double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, eigenvalue, explained, identity_error``: a row for each vector and component."""
    spark = df.sparkSession
    rows = stored(quantised(df, id_col, vec_col, SHIFT), "vectors")
    n, width = rows.agg(F.count(lit(1)), F.max(F.size("x"))).first()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {KIND}"
    if not n or not width:
        return spark.createDataFrame([], schema)
    v = Covariance(rows, n, width)
    values, q = eigenpairs(v, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((v.sums, q / np.sqrt(values), values, values / v.trace))

    def white(x: np.ndarray) -> np.ndarray:
        return ((n * x - sent.value[0]) / n) @ sent.value[1]

    error = float(np.abs(summed(rows, width, lambda x: ((w := white(x)).T @ w).ravel(), "double").reshape(k, k) / n - np.eye(k)).max())
    size = max(1, BLOCK_BYTES // (8 * width))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, _, values, part = sent.value
        for batch in blocks(batches, size):
            x = matrix(batch["x"], width, SHIFT)
            m = len(x)
            each, comp = pa.array(np.repeat(np.arange(m), k)), np.tile(np.arange(k), m)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(each), pa.array((comp + 1).astype(np.int32)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(n * x - s), pa.decimal128(38, 0)).take(each), pa.array(white(x).ravel()), pa.array(values[comp]),
                pa.array(part[comp]), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error"])

    return rows.mapInArrow(give, schema)
