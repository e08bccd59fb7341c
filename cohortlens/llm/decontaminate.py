r"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of q shingles is in a document when at least ``share`` of its distinct shingles are. Comparing the MinHash of
a whole document with that of a short item cannot find this (at 20,000 words against 30 their Jaccard similarity is near
0.001), so the search is one-sided. Items are partitioned by size; an item's sketch is its bottom k hashes with
k = floor((1 - share) q) + 1. If the item is contained, at most k - 1 of its shingles are absent, so at least one sketch
hash occurs in the document: no item is missed. Each size class keeps the largest hash of its sketches, and only document
shingles below the largest of these bounds are looked up.

Documents that meet a sketch send their shingles that occur in any item (a bit table of fixed size tells most others
apart) to a join with the items' shingles, word for word, and an item counts when enough distinct ones are there.

Words: text with A-Z in lower case, runs of ASCII letters and digits and of characters outside ASCII. A text of fewer than
five words is one shingle.
Defined results: null text counts as empty; a text without words has no shingles and is neither found nor leaked; items
with equal ids are one item with the shingles of all its rows; rows that repeat id and text give one row; empty tables
give no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import Known, by_value, docs, few_texts, release, slices, text_key
from cohortlens.session import stored

by_value(__name__)
col, lit = F.col, F.lit

WIDTH, SHARE = 5, 0.8
#: Bits of the tables that are broadcast: 512 KB each, whatever the number of items.
TABLE = 1 << 22
#: Any byte that is no letter or digit but ASCII ends a word.
NO_WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Multipliers for the words of a shingle.
MIX = tuple(pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WIDTH, 0, -1))


def words(text: str) -> list[bytes]:
    return [w for w in NO_WORD.split(text.encode("utf-8", "replace").lower()) if w]


def shingle_hashes(ws: list[bytes], known: Known) -> np.ndarray:
    """Hash of each shingle of a word list; ``known`` keeps word hashes within a task."""
    if not ws:
        return np.empty(0, np.uint64)
    known.learn(set(ws), xxhash.xxh64_intdigest)
    h = np.fromiter(map(known.of.__getitem__, ws), dtype=np.uint64, count=len(ws))
    k = min(WIDTH, len(ws))
    out = np.zeros(len(ws) - k + 1, np.uint64)
    for i in range(k):
        out += h[i:len(h) - k + 1 + i] * np.uint64(MIX[i])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingle_text(ws: list[bytes], at: int) -> str:
    return b" ".join(ws[at:at + WIDTH]).decode("utf-8", "replace")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, shingle, h``: distinct shingles of each item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            at, texts, hs = [], [], []
            for n, t in enumerate(batch["text"].to_pylist()):
                ws = words(t)
                for i, h in enumerate(shingle_hashes(ws, known).view(np.int64).tolist()):
                    at.append(n), texts.append(shingle_text(ws, i)), hs.append(h)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(hs, pa.int64())], ["item_id", "shingle", "h"])

    d = few_texts(docs(items, id_col, text_col))
    return d.mapInArrow(cut, f"item_id {d.schema['doc_id'].dataType.simpleString()}, shingle string, h long").distinct()


def _tables(hashes: DataFrame) -> dict[int, np.ndarray]:
    """Packed bit table per size class, put together on the executors: TABLE / 64 words a class reach the driver at most."""
    slot = F.pmod(F.shiftrightunsigned("h", 8), lit(TABLE))
    word = F.bit_or(F.call_function("shiftleft", lit(1).cast("long"), F.pmod(slot, lit(64)).cast("int"))).alias("b")
    rows = hashes.groupBy("size", F.floor(slot / 64).alias("w")).agg(word).toArrow()
    size, w, b, out = rows["size"].to_numpy(), rows["w"].to_numpy(), rows["b"].to_numpy(), {}
    for c in set(size.tolist()):
        table = np.zeros(TABLE // 64, np.int64)
        table[w[size == c]] = b[size == c]
        out[c] = table.view(np.uint8)
    return out


def find_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id, _t, item_id, n_shared, n_item, containment``: contained items per document (``_t`` is its text's hash)."""
    spark = documents.sparkSession
    parts = stored(item_shingles(items, item_id, item_text), "items")
    of = Window.partitionBy("item_id")
    # Unsigned order of hashes: the sign bit is flipped.
    low = parts.withColumn("n", F.count(lit(1)).over(of)).withColumn("k", F.row_number().over(of.orderBy(col("h").bitwiseXOR(lit(-(1 << 63))), "shingle")))
    sketch = stored(low.where(col("k") <= F.floor(lit(1 - share + 1e-9) * col("n")) + 1).select("h", F.floor(F.log2("n")).alias("size")), "sketches")
    # One bound and one bit table per size class: powers of two, so a few dozen at most.
    bounds = {r["size"]: r["top"] + (1 << 63) for r in sketch.groupBy("size").agg(F.max(col("h").bitwiseXOR(lit(-(1 << 63)))).alias("top")).collect()}
    tables = _tables(sketch)
    every = _tables(parts.withColumn("size", lit(0))).get(0, np.zeros(TABLE // 8, np.uint8))
    shared = spark.sparkContext.broadcast(([(c, bounds[c], tables[c]) for c in sorted(bounds)], every))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = lambda x: np.unpackbits(x, bitorder="little").astype(bool)
        classes = [(share * 2 ** c, np.uint64(bound), open_up(x)) for c, bound, x in shared.value[0]]
        in_item = open_up(shared.value[1])
        known = Known()
        for batch in (part for whole in batches for part in slices(whole)):
            at, texts = [], []
            for n, t in enumerate(batch["text"].to_pylist()):
                ws = words(t)
                h = shingle_hashes(ws, known)
                slot = (h >> np.uint64(8)) & np.uint64(TABLE - 1)
                # A document with fewer shingles than the least share of a class cannot hold its items.
                if not any(len(h) >= least and table[slot[h <= bound]].any() for least, bound, table in classes):
                    continue
                found = {shingle_text(ws, i) for i in np.flatnonzero(in_item[slot]).tolist()}
                at.extend([n] * len(found)), texts.extend(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), batch["_t"].take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], ["doc_id", "_t", "shingle"])
        release()

    d = few_texts(docs(documents, id_col, text_col)).withColumn("_t", text_key("text"))
    hits = d.mapInArrow(search, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, _t long, shingle string")
    sizes = parts.groupBy("item_id").agg(F.count_distinct("shingle").alias("n_item"))
    counted = hits.join(parts.select("item_id", "shingle").distinct(), "shingle").groupBy("doc_id", "_t", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    out = counted.join(sizes, counted["item_id"].eqNullSafe(sizes["item_id"])).select(
        "doc_id", "_t", counted["item_id"], "n_shared", "n_item", (col("n_shared") / col("n_item")).alias("containment"))
    return out.where(col("n_shared") >= lit(share - 1e-9) * col("n_item"))
