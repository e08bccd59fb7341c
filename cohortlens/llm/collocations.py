r"""Phrase collocation mining: the stripes pattern.

A stripe is a prefix with an associative counter of the words that follow it. Stripes of 0, 1, 2 … words are built level by
level: each task counts ``(prefix, next word)`` over its texts, and the stripes of all tasks are merged elementwise, one key
per element, so a prefix that a third of all text holds is no larger a group than any other. An element is the count of an
extension; the total of a prefix is its own element in the stripe one word shorter; the largest element that holds a
phrase at its begin, end or inside decides whether the phrase is subsumed.

A phrase with ``min_count`` occurrences has only parts with as many, so a level counts windows whose two parts of one word
less passed the level before. Tasks test that in a bit table of bounded size (at most 2^27 bits whatever the corpus, broadcast); its errors
let more windows through to the exact merge, never fewer.

Scores use whole numbers only: ``floor(2000000 a / (l + r))`` in decimals of 38 digits.

Defined results: null text counts as empty, null language as ``und``; rows that repeat count each time; very long texts are
counted whole, in segments that overlap by a phrase; equal scores go by count, then by the phrase's bytes; an empty table
gives no rows. Columns other than language and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value, few_texts, release
from cohortlens.session import stored

by_value(__name__)
col, lit = F.col, F.lit

#: Words and bytes of text that a task holds before it hands over its stripes; bytes of a text that are cut, and places that are looked up, at once.
WORDS, BYTES, SEGMENT, STEP = 5_000_000, 64_000_000, 4_000_000, 500_000
#: Bits of the table of frequent parts: at least, at most, and per part.
LEAST, MOST, PER_PART = 1 << 20, 1 << 27, 16
END, MIX = b"\xff", np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def cut_table() -> bytes:
    """Ends of pieces become a byte that no UTF-8 text holds, the other word borders blanks."""
    table = bytearray(range(256))
    for b in b".,;:!?\n\v\f\r":
        table[b] = END[0]
    table[9] = 32
    return bytes(table)


def segments(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces of a text, a few million bytes at a time, cut between words."""
    at = 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        part = text[at:end].lower().translate(table)
        yield part.replace(END, b" \xff ").split()
        at = end
    yield [END]


def word_hashes(words: list[bytes], lang: bytes) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, len(words)) ^ np.uint64(xxhash.xxh64_intdigest(lang, 11))


def joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0].copy()
    for p in parts[1:]:
        h *= MIX
        h += p
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def stripes(t: np.ndarray, words: list[bytes], lang: bytes, m: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``lang, prefix, next, n`` of the windows of ``m`` words in ``t``; level 1 also has the number of all words."""
    v = pa.array(words, pa.binary())
    if m == 1:
        n = np.bincount(t, minlength=len(words))
        n[0] = 0
        at = np.flatnonzero(n)
        prefix, after, counts = pa.array([b""], pa.binary()).take(pa.array(np.zeros(len(at) + 1, np.int64))), v.take(pa.array(at)), n[at]
        after, counts = pa.concat_arrays([after, pa.array([None], pa.binary())]), np.append(counts, counts.sum())
    else:
        size = len(t) - m + 1
        if size < 1:
            return
        h, at = word_hashes(words, lang), []
        for lo in range(0, size, STEP):  # a bounded number of places at a time
            here = h[t[lo:lo + STEP + m]]
            slot = joined_hash([here[j:len(here) - m + 2 + j] for j in range(m - 1)]) & np.uint64(8 * len(table) - 1)
            known = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            ok = (known[:-1] & known[1:])[:STEP]
            for j in range(m):
                ok &= t[lo + j:lo + j + len(ok)] > 0
            at.append(np.flatnonzero(ok) + lo)
        at = np.concatenate(at)
        key = t[at].astype(np.int64)
        for j in range(1, m):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key *= len(words)
            key += t[at + j]
        if m == 2:  # most windows are of two words: a sort in place, and the key itself has both words
            del at
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(key)))
            key = key[first]
            parts = [v.take(pa.array(key // len(words))), v.take(pa.array(key % len(words)))]
        else:
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            parts = [v.take(pa.array(t[at[first] + j])) for j in range(m)]
        prefix, after = parts[0] if m == 2 else pc.binary_join_element_wise(*parts[:-1], pa.scalar(b" ", pa.binary())), parts[-1]
    names = pa.array([lang], pa.binary()).take(pa.array(np.zeros(len(counts), np.int64)))
    batch = pa.RecordBatch.from_arrays([names.cast(pa.string()), prefix.cast(pa.string()), after.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "prefix", "next", "n"])
    for at in range(0, batch.num_rows, 100_000):
        yield batch.slice(at, 100_000)


def level(texts: DataFrame, m: int, parts: Broadcast | None) -> DataFrame:
    """Merged stripes of prefixes of ``m - 1`` words: ``lang, prefix, next, n``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cut_table(), {}
        table = parts.value if parts else None
        words = size = 0

        def hand_over() -> Iterator[pa.RecordBatch]:
            for lang, (v, ts) in held.items():
                t = np.concatenate(ts)
                names = list(v)
                yield from stripes(t, names, lang, m, table)
                # The last words begin phrases that go on in what comes next.
                v, keep = Numbers({END: 0}), [names[i] for i in t[len(t) - min(len(t), m - 1):]]
                held[lang] = v, [np.fromiter(map(v.__getitem__, keep), np.int32, len(keep))]

        for batch in batches:
            for lang, text in zip(batch["lang"].cast(pa.binary()), batch["text"].cast(pa.binary()), strict=True):
                for part in segments(text.as_py(), cut):
                    v, ts = held.setdefault(lang.as_py(), (Numbers({END: 0}), []))
                    ts.append(np.fromiter(map(v.__getitem__, part), np.int32, len(part)))
                    words += len(part)
                size += len(text.as_buffer())
                if words >= WORDS or size >= BYTES:
                    yield from hand_over()
                    words = size = 0
        yield from hand_over()
        held.clear()
        release()

    made = texts.mapInArrow(count, "lang string, prefix string, next string, n long")
    return made.groupBy("lang", "prefix", "next").agg(F.sum("n").alias("n"))


def part_table(frequent: DataFrame) -> Broadcast:
    """Bit table of the hashes of a level's frequent phrases, put together on the executors and broadcast."""
    n = frequent.count()
    bits = min(MOST, max(LEAST, 1 << (PER_PART * n - 1).bit_length())) if n else LEAST

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                h = word_hashes(phrase.encode().split(b" "), lang.encode())
                out.append(int(joined_hash([h[j:j + 1] for j in range(len(h))])[0]) & (bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["slot"])

    bit = F.call_function("shiftleft", lit(1).cast("int"), F.pmod("slot", lit(8)).cast("int"))
    found = frequent.select("lang", "phrase").mapInArrow(slots, "slot long").groupBy(F.floor(col("slot") / 8).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(table)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, min_count: int = 30) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, m, a`` of all phrases of up to ``longest`` words with ``min_count`` occurrences, and ``lang, n``."""
    texts = few_texts(df).select(F.coalesce(col(lang_col).cast("string"), lit("und")).alias("lang"), F.coalesce(col(text_col), lit("")).alias("text"))
    found, totals, parts = None, None, None
    for m in range(1, longest + 1):
        kept = stored(level(texts, m, parts).where((col("n") >= min_count) | col("next").isNull()), f"stripes-{m}")
        if m == 1:
            totals = kept.where(col("next").isNull()).select("lang", "n")
        now = kept.where(col("next").isNotNull()).select(
            "lang", F.when(col("prefix") == "", col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), lit(m).alias("m"), col("n").alias("a"))
        found = now if found is None else found.unionByName(now)
        if parts:
            parts.unpersist()
        if m < longest:
            parts = part_table(now)
    return found, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, min_count: int = 30, subsumed: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase that lies inside a longer one with at least ``subsumed`` percent of its count is left out.
    """
    counts, totals = phrase_counts(df, text_col, lang_col, longest, min_count)
    # Both sides of a join come from the same few files; a renamed copy keeps their columns apart.
    known = lambda name, value: counts.select(col("lang"), col("phrase").alias(name), col("a").alias(value))
    phrases = counts.where(col("m") > 1).withColumn("w", F.split("phrase", " "))
    some = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = phrases.select("lang", "phrase", "m", "a", "w", F.explode(F.sequence(lit(1), col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", some(lit(1), col("k")).alias("first"), some(col("k") + 1, col("m") - col("k")).alias("rest"))
    scored = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    inside = phrases.where(col("m") > 2).select("lang", "m", "w", "a", F.explode(F.sequence(lit(2), col("m") - 1)).alias("size")).select(
        "lang", "w", "a", "size", F.explode(F.sequence(lit(1), col("m") - col("size") + 1)).alias("at")).select(
        "lang", some(col("at"), col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: col(c).cast("decimal(20,0)")
    free = lowest.join(inside, ["lang", "phrase"], "left").where(col("longer").isNull() | (wide("longer") * 100 < wide("a") * subsumed))
    order = Window.partitionBy("lang").orderBy(col("score").desc(), col("a").desc(), "phrase")
    # Spark keeps the first rows of each task before the shuffle, so a language's window holds at most ``top`` rows a task.
    ranked = free.withColumn("rank", F.row_number().over(order)).where(col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
