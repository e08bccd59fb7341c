r"""SimHash near-duplicates: pivot distance tables.

Fingerprints are 64 majority bits over the XXH64 of a text's word shingles. Links between fingerprints at most ``BITS``
apart are found among distinct fingerprints, so copies never meet in pairs:

1. Of seven bit blocks, a pair within four bits agrees on at least three; each fingerprint therefore goes to 35 groups,
   one per choice of three blocks (27 bits or more, so that unlike fingerprints seldom meet). Groups of one are left out by a count; groups of
   two are settled by the count's minimum and maximum; larger groups get their members by a join, before which a bit table leaves
   out nearly all fingerprints that are in none.
2. In a group of up to ``GROUP`` fingerprints, a table holds each one's Hamming distance to ``PIVOTS`` reference
   fingerprints. Distances to one reference differ by no more than the pair's own distance, so a pair is discarded by its
   maximum coordinate difference; survivors are verified. Sorted by the first coordinate, only rows near each other are
   looked at. A group gives a spanning forest of its links, never all pairs.
3. Larger groups (many near copies of one text) are not compared at all: two fingerprints are at most four bits apart
   exactly if some fingerprint is at most two bits from both, so each member is linked to the smallest member around every
   value within two bits of itself: 2081 values a fingerprint, in proportion to the group.

Pivot tables alone would leave all pairs of the corpus to compare, hence step 1. All three steps are exact.

Words: text with A-Z in lower case, runs of ``[^\x20\x09-\x0D]``.
Defined results: null text counts as empty, with fingerprint zero, linked like any other; the smallest id of a component
passes over null ids (null if it has no other); rows that repeat share fingerprint and component; an empty table gives no
rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value, text_key
from cohortlens.operators.graph import connected_components
from cohortlens.session import stored

by_value(__name__)
col, lit = F.col, F.lit

BITS, BLOCKS, GROUP, PIVOTS, SEED = 4, 7, 2048, 16, 42
#: Shingles that are counted at once.
STEP = 1 << 18
#: Bits of the table of groups above two, in words of 64: at most 2^18 rows of a broadcast, however many groups there are.
SPOTS = 1 << 24


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    total, digest = np.zeros(2048, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), STEP):
        h = np.array([digest(flat[s:e], SEED) for s, e in zip(starts[i:i + STEP], ends[i:i + STEP], strict=True)], dtype="<u8")
        total += np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    # Counts of byte values at each of the eight bytes, and which values have which bit.
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = (total.reshape(8, 256) @ bits).ravel()
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(starts)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, _t, fp``: one fingerprint (as a signed long) per row, and the hash of its text."""
    @F.pandas_udf("long")
    def prints(texts):
        return texts.map(lambda t: fingerprint(t or "", shingle)).astype("uint64").astype("int64")

    return df.select(col(id_col).alias("doc_id"), text_key(text_col).alias("_t"), prints(col(text_col)).alias("fp"))


def block_masks() -> list[int]:
    """For each choice of three of the seven blocks, the bits that have to agree, as a signed long."""
    cuts = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, BLOCKS - BITS)]


def forest(fps: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, by a pivot distance table."""
    x = fps.view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    x, table, out = x[order], table[order], []
    ends = np.searchsorted(table[:, 0], table[:, 0] + BITS, side="right")
    top = np.arange(len(x))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(x)):
        near = np.abs(table[i + 1:ends[i]] - table[i]).max(axis=1, initial=0) <= BITS
        js = i + 1 + np.flatnonzero(near)
        for j in js[np.bitwise_count(x[js] ^ x[i]) <= BITS]:
            a, b = root(i), root(int(j))
            if a != b:
                top[b] = a
                out.append((int(x[i].view(np.int64)), int(x[j].view(np.int64))))
    return out


def in_groups(keyed: DataFrame, groups: DataFrame, spots: int = SPOTS) -> DataFrame:
    """Rows of ``keyed`` with their group of ``groups`` (``c, key, n``). A bit table of the groups keeps nearly all other
    rows out of the shuffle; its errors only let rows through to the join, which is exact."""
    spot = F.pmod(F.xxhash64("c", "key"), lit(spots))
    word, bit = F.shiftright(spot, 6).alias("_w"), F.call_function("shiftleft", lit(1).cast("long"), spot.bitwiseAND(lit(63)).cast("int"))
    table = groups.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    likely = keyed.select("*", word, bit.alias("_bit")).join(F.broadcast(table), "_w").where(col("_bits").bitwiseAND(col("_bit")) != 0)
    return likely.select(*keyed.columns).join(groups, ["c", "key"])


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """``src, dst``: links among the distinct values of ``fp`` that connect what is at most four bits apart."""
    masks = [F.struct(lit(i).alias("c"), col("fp").bitwiseAND(lit(m)).alias("key")) for i, m in enumerate(block_masks())]
    keyed = fps.select("fp", F.inline(F.array(*masks)))
    sizes = stored(keyed.groupBy("c", "key").agg(F.count(lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where(col("n") > 1), "simhash-groups")
    pairs = sizes.where((col("n") == 2) & (F.bit_count(col("a").bitwiseXOR(col("b"))) <= BITS)).select(col("a").alias("src"), col("b").alias("dst"))
    members = stored(in_groups(keyed, sizes.where(col("n") > 2).select("c", "key", "n")), "simhash-members")
    # A group of the same members comes up under many choices of blocks; it is looked at once.
    small = members.where(col("n") <= group).groupBy("c", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps")).select("fps").distinct()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.random.default_rng(7).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            found = [e for fps in batch["fps"] for e in forest(fps.values.to_numpy(), pivots)]
            yield pa.RecordBatch.from_pydict({k: pa.array([e[i] for e in found], pa.int64()) for i, k in enumerate(("src", "dst"))})

    # Settling is the costly part, so its rows are dealt evenly whatever their bytes.
    settled = small.repartition(F.xxhash64("fps")).mapInArrow(settle, "src long, dst long")
    hot = members.where(col("n") > group).select("fp").distinct()
    one = F.transform(F.sequence(lit(0), lit(63)), lambda i: F.call_function("shiftleft", lit(1).cast("long"), i))
    around = F.flatten(F.transform(F.sequence(lit(0), lit(64)), lambda i: F.transform(
        F.sequence(i, lit(64)), lambda j: F.element_at(col("bits"), i + 1).bitwiseXOR(F.when(j == i, 0).otherwise(F.element_at(col("bits"), j + 1))))))
    # Bit 64 stands for no bit: pairs (i, 64) are single bits, and (64, 64) is the value itself.
    spots = hot.withColumn("bits", F.concat(one, F.array(lit(0).cast("long")))).select("fp", F.explode(F.array_distinct(around)).alias("m")).select(
        "fp", col("fp").bitwiseXOR(col("m")).alias("z"))
    first = spots.groupBy("z").agg(F.min("fp").alias("src"), F.max("fp").alias("_x")).where(col("src") != col("_x")).select("z", "src")
    wide = spots.join(first, "z").where(col("fp") != col("src")).select("src", col("fp").alias("dst"))
    return pairs.unionByName(settled).unionByName(wide).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, group: int = GROUP) -> DataFrame:
    """``doc_id, _t, fp, root, component_id`` for each row: text hash, fingerprint, the smallest fingerprint that links
    lead to, and the smallest id that they lead to."""
    rows = stored(fingerprints(df, id_col, text_col, shingle), "simhash")
    smallest = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    comp = connected_components(links(smallest.select("fp"), group)).select(col("node").alias("fp"), col("component").alias("root"))
    named = comp.join(smallest, "fp").groupBy("root").agg(F.min("doc_id").alias("low"))
    of = smallest.join(comp.join(named, "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(col("root").isNotNull(), col("low")).otherwise(col("doc_id")).alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "_t", "fp", "root", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, group: int = GROUP) -> DataFrame:
    """``_id, _t`` of the document of each component that stays: smallest id (null last), then text hash."""
    best = F.min(F.struct(col("doc_id").isNull(), "doc_id", "_t")).alias("best")
    return near_duplicates(df, id_col, text_col, shingle, group).groupBy("root").agg(best).select(col("best.doc_id").alias("_id"), "best._t")
