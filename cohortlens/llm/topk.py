"""Exact top-k search by inner product: a bit-sliced index.

Vectors are whole numbers. The rows stand in blocks; a block keeps the top bits of each component, counted from the
component's least value in the block, as bitmaps over its rows: slice b of a component has the bit b of every row.

1. A query's weighted sum of components is made for all rows of a block at once: for each bit of a weight, the slices of its
   component (their complements for negative weights) are added, shifted by the bit's place. Carry-save adders, three
   bitmaps to two, bring each place down to one bitmap: the slices of the approximate score.
2. The k-th largest approximate score is found from the most significant slice downward. What the cut-off bits can change
   is at most the length of the query times that of the longest remainder in the block (Cauchy-Schwarz), so rows further
   than twice that below the k-th are out, as are rows that cannot reach the k-th best score that the task has seen.
3. The boundary rows that are left are resolved by their whole vectors, with ties to the smaller id.

The queries come in chunks of bounded size, each broadcast by itself; each task keeps k rows of each query of the chunk, and
the tasks' lists are merged by query. All rows are candidates of all queries; a query's own row is not.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled
up with zeros; equal scores go to the smaller id, null ids last; rows that repeat an id are rows of their own, as queries and
as candidates; a query with fewer candidates than k has them all; an empty table gives no rows; a score that could exceed 63
bits is an error. Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value
from cohortlens.llm.vectors import blocks, matrix, quantised
from cohortlens.session import scratch_path, stored

by_value(__name__)
col, lit = F.col, F.lit

#: Bits of a component in the index; bytes of whole vectors in a block, and its rows at most; bytes of a chunk of queries.
BITS, BLOCK_BYTES, BLOCK_ROWS, CHUNK_BYTES = 7, 32 << 20, 8192, 4 << 20


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Slices, lowest first, of the sum of bitmaps: ``columns[c]`` has those that count 2^c each."""
    out, carried, c = [], [], 0
    while c < len(columns) or carried:
        held = [*(columns[c] if c < len(columns) else []), *carried]
        stack, carried = np.concatenate(held) if held else None, []
        while stack is not None and len(stack) > 2:
            m = len(stack) // 3
            a, b, d = stack[:m], stack[m:2 * m], stack[2 * m:3 * m]
            x = a ^ b
            carried.append((a & b) | (x & d))
            stack = np.concatenate([x ^ d, stack[3 * m:]])
        if stack is not None and len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        out.append(None if stack is None else stack[0])
        c += 1
    return out


class Block:
    """Bit-sliced index of the rows of ``x``."""

    def __init__(self, x: np.ndarray, bits: int = BITS):
        self.x, (self.n, width) = x, x.shape
        self.low = x.min(axis=0)
        up = x - self.low
        self.shift = max(0, int(up.max(initial=0)).bit_length() - bits)
        top = up >> self.shift
        self.half = ((1 << self.shift) - 1) / 2
        rest = (up - (top << self.shift)) - self.half
        #: No row's remainder is longer.
        self.longest = math.sqrt(float((rest * rest).sum(axis=1).max(initial=0))) * (1 + 1e-9)
        self.bits = bits
        words = -(-self.n // 64)
        plain = np.zeros((bits, width, 8 * words), np.uint8)
        for b in range(bits):
            packed = np.packbits((top >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
            plain[b, :, :packed.shape[1]] = packed
        plain = plain.view(np.uint64)
        self.slices = np.stack([plain, ~plain])
        full = np.zeros(8 * words, np.uint8)
        full[:-(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.full = full.view(np.uint64)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the approximate score, counted from the least that the weights allow."""
        weight, sign = np.abs(q), (q < 0).astype(np.int64)
        columns: list[list[np.ndarray]] = [[] for _ in range(int(weight.max(initial=0)).bit_length() + self.bits)]
        for j in range(len(columns) - self.bits):
            on = np.flatnonzero(weight >> j & 1)
            if len(on):
                for b in range(self.bits):
                    columns[j + b].append(self.slices[sign[on], b, on])
        zero = np.zeros_like(self.full)
        return [zero if s is None else s for s in added(columns)]

    def candidates(self, q: np.ndarray, k: int, own: int | None, least: int | None) -> np.ndarray:
        """Places of the rows that can be among the ``k`` best of the block, without ``own`` and those surely below ``least``."""
        left = self.full.copy()
        if own is not None:
            left[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        k = min(k, int(np.bitwise_count(left).sum()))
        if not k:
            return np.empty(0, np.int64)
        slices = self.scores(q)
        kth, above, equal = 0, 0, left
        for c in range(len(slices) - 1, -1, -1):
            on = equal & slices[c]
            n = int(np.bitwise_count(on).sum())
            if above + n >= k:
                equal, kth = on, kth | 1 << c
            else:
                above, equal = above + n, equal & ~slices[c]
        error = math.sqrt(float((q.astype(np.float64) ** 2).sum())) * self.longest * (1 + 1e-9)
        floor = kth - math.ceil(2 * error / (1 << self.shift)) - 1
        if least is not None:
            # What the slices leave out, alike for all rows: least values, half remainders, complements.
            alike = float(q @ self.low) + float(q.sum()) * self.half - float(-q[q < 0].sum()) * ((1 << self.bits) - 1) * (1 << self.shift)
            slack = error + 1e-9 * (abs(alike) + abs(least)) + 1
            floor = max(floor, math.floor((least - alike - slack) / (1 << self.shift)))
        if floor > 0:
            if floor >> len(slices):
                return np.empty(0, np.int64)
            more = np.zeros_like(left)
            for c in range(len(slices) - 1, -1, -1):
                if floor >> c & 1:
                    left = left & slices[c]
                else:
                    more |= left & slices[c]
                    left = left & ~slices[c]
            left = left | more
        return np.flatnonzero(np.unpackbits(left.view(np.uint8), count=self.n, bitorder="little"))


class Best:
    """The ``k`` best rows of each of ``m`` queries so far."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.found: list[tuple[np.ndarray, ...] | None] = [None] * m

    def least(self, i: int) -> int | None:
        return int(self.found[i][0][-1]) if self.found[i] is not None and len(self.found[i][0]) == self.k else None

    def add(self, i: int, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        if self.found[i] is not None:
            score, none, ids = (np.concatenate(p) for p in zip(self.found[i], (score, none, ids), strict=True))
        at = np.lexsort((ids, none, -score))[:self.k]
        self.found[i] = score[at], none[at], ids[at]


def block_rows(width: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1)) // 64 * 64))


def search(rows: DataFrame, queries: DataFrame, width: int, k: int, bits: int) -> DataFrame:
    """``q, query_id, vec_id, score``: of each task, the ``k`` best rows of each query."""
    asked = queries.toArrow().combine_chunks()
    ids = pa.array([]) if not asked.num_rows else asked["vec_id"].combine_chunks()
    sent = rows.sparkSession.sparkContext.broadcast((
        asked["row"].to_numpy(), ids.to_pylist(), matrix(asked["x"].combine_chunks(), width) if asked.num_rows else np.empty((0, width), np.int64)))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, qs = sent.value
        best = Best(len(own), k)
        longest = int(np.abs(qs).max(initial=0))
        for batch in blocks(batches, block_rows(width)):
            x = matrix(batch["x"], width)
            if longest * int(np.abs(x).max(initial=0)) * max(width, 1) >= 1 << 62:
                raise OverflowError("an inner product may not fit 64 bits")
            block, row = Block(x, bits), batch["row"].to_numpy()
            none, vec = batch["vec_id"].is_null().to_numpy(zero_copy_only=False), batch["vec_id"].fill_null(0).to_numpy()
            place = {r: i for i, r in enumerate(row.tolist())}
            for i, q in enumerate(qs):
                at = block.candidates(q, k, place.get(int(own[i])), best.least(i))
                if len(at):
                    best.add(i, x[at] @ q, none[at], vec[at])
        for at in range(0, len(own), 4096):
            some = [i for i in range(at, min(at + 4096, len(own))) if best.found[i] is not None]
            if some:
                score, none, vec = (np.concatenate(p) for p in zip(*(best.found[i] for i in some), strict=True))
                sizes = [len(best.found[i][0]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own[some], sizes)), pa.array([names[i] for i in some], batch_type).take(pa.array(np.repeat(np.arange(len(some)), sizes))),
                     pa.array(vec, batch_type, mask=none), pa.array(score)], ["q", "query_id", "vec_id", "score"])

    batch_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else None
    if batch_type is None:
        raise TypeError("ids must be whole numbers")
    return rows.mapInArrow(look, f"q long, query_id {kind}, vec_id {kind}, score long")


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` other rows of the highest inner products."""
    spark = df.sparkSession
    found = stored(quantised(df, id_col, vec_col), "vectors")
    n, width, asked = found.agg(F.count(lit(1)), F.max(F.size("x")), F.count_if(col("vec_id") % every == 0)).first()
    width = width or 0
    rows = stored(found.repartition(max(1, -(-n // block_rows(width)))).withColumn("row", F.monotonically_increasing_id()), "blocks")
    chunks = max(1, -(-asked * 8 * max(width, 1) // CHUNK_BYTES))
    order = Window.partitionBy("q").orderBy(col("score").desc(), col("vec_id").asc_nulls_last())
    out = scratch_path(spark, "top")
    for c in range(chunks):
        # Row numbers are hashed, so chunks are about equal.
        queries = rows.where((col("vec_id") % every == 0) & (F.pmod(F.xxhash64("row"), lit(chunks)) == c))
        merged = search(rows, queries, width, k, bits).withColumn("rank", F.row_number().over(order)).where(col("rank") <= k)
        merged.select("query_id", col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(out)
    kind = found.schema["vec_id"].dataType.simpleString()
    return spark.read.schema(f"query_id {kind}, rank int, vec_id {kind}, score long").parquet(out)
