"""Language ID: language-bitmask n-gram filters.

Each language has a set of n-grams that are frequent in it. One Bloom filter holds all sets, bit-sliced: a slot is a mask
with one bit per language, and the AND over an n-gram's slots names every language that may contain it. A text's n-grams
are looked up, hits are counted per language, and the share of hits is corrected for the language's false positives (from
how full its slice is) and divided by the share that the language's own texts reach; the largest value decides.

N-grams are four characters of the lower-case text, where everything but letters is one blank.

The sets are fitted on a bounded sample of the labelled rows: about ``fit_rows`` whole texts per language, chosen by a hash
of the id (all rows if there are fewer). Every row is then predicted from its whole text.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text of fewer letters than an n-gram is filled up
with blanks; very long texts are read whole, in chunks that overlap; without any labelled row every text is
``und``; equal values go to the language first in the alphabet; a null id counts as empty text in the hold-out rule; rows
that repeat get the same result each; an empty table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import by_value, few_texts, release

by_value(__name__)
col, lit = F.col, F.lit

N = 4
#: Odd multipliers for slots; slots of the filter; n-grams of a language at most, and their least share of its sample.
HASHES, SLOTS, GRAMS, LEAST = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 1 << 20, 60_000, 2e-6
CHUNK = 2_000_000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every character, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's n-grams, in chunks; none for a text without letters."""
    for at in range(0, len(text), CHUNK):  # neighbouring chunks share the characters that an n-gram needs
        low = text[max(0, at - N):at + CHUNK].lower()
        x = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = letters[x]
        if not letter.any():
            continue
        x = np.where(letter, x, 32).astype(np.uint64)
        x = x[letter | np.concatenate([[True], letter[:-1]])]
        x = np.concatenate([[32], x, [32]]).astype(np.uint64) if at + CHUNK >= len(text) and at == 0 else x
        if len(text) <= CHUNK and len(x) < N:  # a text of one letter has one n-gram too
            x = np.concatenate([x, np.full(N - len(x), 32, np.uint64)])
        if len(x) >= N:
            h = x[:len(x) - N + 1].copy()
            for i in range(1, N):
                h *= np.uint64(0x100000001B3)
                h += x[i:len(x) - N + 1 + i]
            yield h


def slots(h: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [(h * np.uint64(m)) >> shift for m in HASHES]


@dataclass
class Model:
    """``masks``: a language mask per slot; ``wrong``: false-positive rates; ``own``: share of hits in own texts."""

    languages: list[str]
    letters: np.ndarray
    masks: np.ndarray
    wrong: np.ndarray
    own: np.ndarray

    def values(self, text: str | None) -> np.ndarray | None:
        """Corrected share of hits per language; None if the text has no letter."""
        hits, total = np.zeros(len(self.languages)), 0
        for h in grams(text or "", self.letters):
            a, b, c = slots(h)
            found = self.masks[a] & self.masks[b] & self.masks[c]
            hits += [np.count_nonzero(found & self.masks.dtype.type(1 << i)) for i in range(len(self.languages))]
            total += len(h)
        if not total:
            return None
        return np.maximum((hits / total - self.wrong) / (1 - self.wrong), 0) / self.own

    def predict(self, text: str | None) -> tuple[str, float]:
        v = self.values(text) if self.languages else None
        if v is None:
            return UNKNOWN, 0.0
        return self.languages[int(v.argmax())], float(min(1.0, v.max()))


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), lit(""))), lit(4)) == 2


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4000) -> Model:
    """Fit on rows of ``df`` with a label and a text. At most 64 languages; what reaches the driver is ``GRAMS`` hashes each."""
    letters = letter_table()
    rows = few_texts(df).where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(65).collect()}
    if len(counts) > 64:
        raise ValueError("a mask holds 64 languages")
    if not counts:
        return Model([], letters, np.zeros(SLOTS, np.uint8), np.zeros(0), np.zeros(0))
    share = F.create_map(*[x for k, n in counts.items() for x in (lit(k), lit(fit_rows / n))])
    spot = F.pmod(F.xxhash64("id"), lit(1 << 30)) / float(1 << 30)
    sample = rows.where(spot < F.element_at(share, col("lang")))

    packed = df.sparkSession.sparkContext.broadcast(np.packbits(letters))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                by.setdefault(lang, []).extend(grams(text, table))
            for lang, hs in by.items():
                if hs:
                    g, n = np.unique(np.concatenate(hs), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g)), "g": pa.array(g.view(np.int64)), "n": pa.array(n.astype(np.int64))})
        release()

    seen = sample.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    # Few rows per language (distinct n-grams of the sample) stand in one window.
    w = Window.partitionBy("lang")
    top = seen.withColumn("share", col("n") / F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(col("n").desc(), "g"))).where(
        (col("k") <= GRAMS) & (col("share") >= LEAST)).select("lang", "g", "share").toArrow()
    lang, g, part = np.array(top["lang"].to_pylist(), dtype=object), top["g"].to_numpy().view(np.uint64), top["share"].to_numpy()
    languages = sorted({*lang})
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(t).itemsize)
    masks, wrong, own = np.zeros(SLOTS, kind), [], []
    for i, name in enumerate(languages):
        mine = lang == name
        for s in slots(g[mine]):
            masks[s] |= kind(1 << i)
        wrong.append((np.count_nonzero(masks & kind(1 << i)) / SLOTS) ** len(HASHES))
        own.append(part[mine].sum())
    return Model(languages, letters, masks, np.array(wrong), np.array(own))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score``: whole rows of ``df`` packed in ``row``. The filter, a few MB whatever the input, is broadcast."""
    parts = df.sparkSession.sparkContext.broadcast((model.languages, model.letters, model.masks, model.wrong, model.own))

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*parts.value)
        for s in texts:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])
        release()

    return few_texts(df).select(F.struct("*").alias("row")).withColumn("_p", best(col("row").getField(text_col))).select("row", "_p.lang_pred", "_p.score")
