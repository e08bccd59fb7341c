r"""Line dedup, native: suffix ranks of line sequences by distributed prefix doubling.

A line is a non-blank line together with blank lines after it (blank lines before the first belong to it), compared
without surrounding whitespace; its words are runs of ``[^\x20\x09-\x0D]``. A run is a sequence of lines of one document.
**A line is deleted when it lies in a run of ``min_words`` words or more, all runs lengths allowed, that also occurs
earlier in the corpus** (by document id, text hash, line).

Ranks as in suffix sorting: ``r0`` of a place is the first place with the same line, ``r(k+1)`` the first place where the
pair (r(k) here, r(k) 2^k lines on) is the same. Places whose line is nowhere else drop out at once, places whose 2^k lines
are nowhere else at the next level. The suffixes that agree with a place on m lines, an interval of the suffix array whose
longest common prefix is at least m, are those with equal (r(j) here, r(j) m-2^j lines on), 2^j <= m. For each place the
shortest run from it and the shortest run up to it with ``min_words`` words are looked up that way; the union of the
repeated ones is the union of all repeated runs of that size (a longer repeated run is covered by its shortest runs from
and up to its lines). So levels beyond log2(min_words) are never needed, since no line is without words.

Defined results: null text counts as empty; rows that repeat id and text are one document; a null id comes first; an empty
table gives no rows. A row's other columns pass through ``delete_repeated`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import WS, docs, keyed, same_doc, text_key
from cohortlens.session import stored

col, lit = F.col, F.lit

#: Cuts before each non-blank line but the first.
CUT = r"\n(?=[ \t\x0B\f\r]*[^ \t\n\x0B\f\r])"
WORD = r"[^ \t\n\x0B\f\r]+"
DOC = ["_id", "_t"]


def units(text: Column) -> Column:
    """Lines of a text; leading blank lines stay with the first."""
    parts = F.split(text, CUT)
    # A text that begins with blank lines is cut before its first line too: glue that cut again.
    head = (F.btrim(F.element_at(parts, 1), lit(WS)) == "") & (F.size(parts) > 1)
    glued = F.concat(F.array(F.concat_ws("\n", F.element_at(parts, 1), F.element_at(parts, 2))), F.slice(parts, 3, F.greatest(F.size(parts) - 2, lit(0))))
    return F.when(head, glued).otherwise(parts)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """``_id, _t, n``: places (line numbers from 0) of the lines to delete, each once."""
    lines = docs(df, id_col, text_col).select(col("doc_id").alias("_id"), text_key("text").alias("_t"), F.posexplode(units(col("text"))).alias("n", "line"))
    lines = lines.select(*DOC, "n", F.unhex(F.md5(F.btrim("line", lit(WS)))).alias("line"), F.regexp_count("line", lit(WORD)).alias("w")).where(col("w") > 0)
    lines = stored(lines, "lines")
    place = F.struct(*DOC, "n")
    # Tables of repeated keys are written: the joins with them then read plain shuffles, whose hot keys Spark can split.
    firsts = stored(lines.groupBy("line").agg(F.min(place).alias("r0"), F.count(lit(1)).alias("c")).where(col("c") > 1).drop("c"), "firsts")
    # Rows repeated in full give a place twice: one place is enough.
    rows = stored(lines.join(firsts, "line").select(*DOC, "n", "w", "r0").dropDuplicates([*DOC, "n"]), "ranks")
    along = Window.partitionBy(*DOC).orderBy("n")
    k = 0
    while (1 << (k + 1)) <= min_words:
        step = 1 << k
        there = F.when(F.lead("n", step).over(along) == col("n") + step, F.lead(f"r{k}", step).over(along))
        paired = stored(rows.withColumn("_next", F.when(col(f"r{k}").isNotNull(), there)), "ranks")
        pair = stored(paired.where(col("_next").isNotNull()).groupBy(col(f"r{k}").alias("_a"), col("_next").alias("_b")).agg(
            F.min(place).alias(f"r{k + 1}"), F.count(lit(1)).alias("_c")).where(col("_c") > 1).drop("_c"), "pairs")
        rows = stored(paired.join(pair, (col(f"r{k}") == col("_a")) & (col("_next") == col("_b")), "left").drop("_a", "_b", "_next"), "ranks")
        k += 1

    # Lengths in lines of the shortest run from and up to each place; no run needs more lines than words.
    def shortest(at) -> Column:
        total, out = lit(0), lit(None).cast("int")
        cases = []
        for i in range(min_words):
            n, w = (col("n"), col("w")) if i == 0 else (at("n", i), at("w", i))
            ok = lit(True) if i == 0 else F.abs(n - col("n")) == i
            total = total + w
            cases.append((ok & (total >= min_words), lit(i + 1)))
        for ok, m in reversed(cases):
            out = F.when(ok, m).otherwise(out)
        return out

    ahead = shortest(lambda c, i: F.lead(c, i).over(along))
    back = shortest(lambda c, i: F.lag(c, i).over(along))
    sized = rows.select(*DOC, "n", ahead.alias("ahead"), back.alias("back"))
    runs = sized.select(*DOC, F.explode(F.array(
        F.struct(col("n").alias("n"), col("ahead").alias("m")), F.struct((col("n") - col("back") + 1).alias("n"), col("back").alias("m")))).alias("x")).select(
        *DOC, "x.n", "x.m").where(col("m").isNotNull()).distinct()
    top = lambda m: m.bit_length() - 1  # noqa: E731  largest level that fits into m lines
    here, there = lit(None), lit(None)
    ranks = rows.select(*DOC, "n", *[f"r{i}" for i in range(k + 1)], *[
        F.when(F.lead("n", d).over(along) == col("n") + d, F.lead(f"r{j}", d).over(along)).alias(f"r{j}_{d}")
        for j in range(k + 1) for d in range(1, 1 << j) if (1 << j) + d <= min_words])
    for m in range(1, min_words + 1):
        j, d = top(m), m - (1 << top(m))
        here = F.when(col("m") == m, col(f"r{j}")).otherwise(here)
        there = F.when(col("m") == m, col(f"r{j}_{d}") if d else col(f"r{j}")).otherwise(there)
    looked = runs.join(ranks, [runs["_id"].eqNullSafe(ranks["_id"]), runs["_t"] == ranks["_t"], runs["n"] == ranks["n"]]).select(
        runs["_id"], runs["_t"], runs["n"], "m", here.alias("a"), there.alias("b")).where(col("a").isNotNull() & col("b").isNotNull())
    looked = stored(looked, "runs")
    first = stored(looked.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(lit(1)).alias("c")).where(col("c") > 1).drop("c"), "first-runs")
    later = looked.join(first, ["m", "a", "b"]).where(~place.eqNullSafe(col("first")))
    return later.select(*DOC, F.explode(F.sequence(col("n"), col("n") + col("m") - 1)).alias("n")).distinct()


def delete_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """``row, n_lines, n_deleted, text``: whole rows of ``df`` packed in ``row``, and their texts without repeated lines."""
    along = Window.partitionBy(*DOC).orderBy("n")
    islands = repeated_lines(df, id_col, text_col, min_words).withColumn("g", col("n") - F.row_number().over(along)).groupBy(*DOC, "g").agg(
        F.min("n").alias("a"), (F.max("n") + 1).alias("b"))
    cuts = islands.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    d = keyed(df, id_col, text_col)
    text = F.coalesce(col("row").getField(text_col), lit(""))
    joined = d.join(cuts, same_doc(d, cuts), "left").select("row", units(text).alias("u"), F.coalesce("cuts", F.array().cast("array<struct<a:int,b:int>>")).alias("cuts"), text.alias("text"))
    # What stays lies between the end of one cut and the begin of the next.
    begins = F.concat(F.array(lit(0)), col("cuts.b"))
    ends = F.concat(col("cuts.a"), F.array(F.size("u")))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("s"), ends.alias("e")), lambda x: F.slice(col("u"), x["s"] + 1, x["e"] - x["s"])))
    deleted = F.aggregate("cuts", lit(0), lambda s, x: s + x["b"] - x["a"])
    return joined.select(
        "row", F.when(F.btrim("text", lit(WS)) == "", lit(0)).otherwise(F.size("u")).alias("n_lines"), deleted.alias("n_deleted"),
        F.when(F.size("cuts") == 0, col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
