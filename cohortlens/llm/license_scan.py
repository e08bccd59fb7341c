"""License scans, native: diagonal voting.

Every three consecutive words of a text are joined, by hash and then word for word, with the same in short license texts.
A shared gram at word p of the document and word q of the template votes for the diagonal p - q; the grams seen on a
diagonal are kept as a bit mask of q, so votes are aggregated before anything is shuffled. Neighbouring diagonals (words
put in or left out) are merged while they are at most ``GAP`` apart, and a merged span counts when it covers ``COVER`` of
the template's grams and is no longer than twice the template. A phrase must be covered in full, on one diagonal.

Words: text with A-Z in lower case, runs of ASCII letters and digits and of characters outside ASCII.
Defined results: null text counts as empty (no words, no labels); rows that repeat id and text get the same result each;
an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.frames import docs, text_key

col, lit = F.col, F.lit

K, GAP, COVER = 3, 4, 0.8

#: Phrases of the contract.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Sentences that public licenses ask to be quoted, in lower case without punctuation.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text whose capitals are still there; words begin and end at the same places.
NO_WORD_OR_CAPITAL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def templates(extra: dict[str, str] | None = None) -> list[tuple[str, str, bool, list[str]]]:
    """``name, label, phrase?, words`` of all templates; ``extra`` adds labels of the caller's (each 3 to 64 words)."""
    out = [(f"phrase {k}", k, True, v.split()) for k, v in PHRASES.items()]
    out += [(f"text {k}", k, False, v.split()) for k, v in {**TEMPLATES, **(extra or {})}.items()]
    if any(not K <= len(w) <= 62 + K - 1 for *_, w in out):
        raise ValueError("a template has 3 to 64 words")
    return out


def _grams(df: DataFrame, known: list) -> DataFrame:
    """Template grams as a table: a fixed few hundred rows, built inside the plan."""
    rows = [F.struct(lit(name).alias("template"), lit(label).alias("label"), lit(phrase).alias("phrase"), lit(len(w) - K + 1).alias("grams"),
                     lit(q).alias("q"), *[lit(w[q + i]).alias(f"t{i}") for i in range(K)])
            for name, label, phrase, w in known for q in range(len(w) - K + 1)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows))).withColumn("h", F.xxhash64("t0", "t1", "t2"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, str] | None = None) -> DataFrame:
    """``_id, _t, label, phrase, first_word, n_words, score``: verified spans, distinct per document."""
    d = docs(df, id_col, text_col).select(col("doc_id").alias("_id"), text_key("text").alias("_t"), words(col("text")).alias("w"))
    shifted = F.arrays_zip(*[(col("w") if i == 0 else F.slice("w", i + 1, F.greatest(F.size("w") - i, lit(0)))).alias(f"w{i}") for i in range(K)])
    at = d.select("_id", "_t", F.posexplode(shifted).alias("p", "g")).select("_id", "_t", "p", *[f"g.w{i}" for i in range(K)])
    at = at.where(col(f"w{K - 1}").isNotNull()).withColumn("h", F.xxhash64("w0", "w1", "w2"))
    hits = at.join(F.broadcast(_grams(df, templates(extra))), "h").where(reduce(lambda a, b: a & b, [col(f"w{i}") == col(f"t{i}") for i in range(K)]))
    bit = F.expr("shiftleft(1L, q)")
    lines = hits.groupBy("_id", "_t", "template", "label", "phrase", "grams", (col("p") - col("q")).alias("diagonal")).agg(
        F.bit_or(bit).alias("mask"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    exact = lines.where(col("phrase") & (F.bit_count("mask") == col("grams"))).select(
        "_id", "_t", "label", "phrase", col("lo").alias("first_word"), (col("grams") + (K - 1)).alias("n_words"), lit(1.0).alias("score"))
    group = Window.partitionBy("_id", "_t", "template").orderBy("diagonal")
    # A gap in diagonals, or in the text, begins a new span.
    new = (col("diagonal") - F.lag("diagonal").over(group) > GAP) | (col("lo") - F.lag("hi").over(group) > col("grams"))
    merged = lines.where(~col("phrase")).withColumn("new", F.coalesce(new, lit(True)).cast("int")).withColumn(
        "part", F.sum("new").over(group.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "_id", "_t", "template", "label", "phrase", "grams", "part").agg(
        F.bit_or("mask").alias("mask"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cover = F.bit_count("mask") / col("grams")
    near = merged.where((cover >= COVER) & (col("hi") - col("lo") + K <= 2 * (col("grams") + K - 1))).select(
        "_id", "_t", "label", "phrase", col("lo").alias("first_word"), (col("hi") - col("lo") + K).alias("n_words"), cover.alias("score"))
    return exact.unionByName(near)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per row of ``df``."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a label set has a dozen values at most
    base = F.when(col("phrase"), col("first_word"))
    found = spans(df, id_col, text_col, extra).groupBy("_id", "_t").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        listed(F.when(col("phrase"), col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("score").alias("score"))
    every = docs(df, id_col, text_col).select(
        "doc_id", text_key("text").alias("t"), F.size(F.array_remove(F.split("text", NO_WORD_OR_CAPITAL), "")).cast("long").alias("n_words"))
    return every.join(found, every.doc_id.eqNullSafe(found["_id"]) & (every.t == found["_t"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", lit("")).alias("base_labels"), F.coalesce("labels", lit("")).alias("labels"), F.coalesce("score", lit(0.0)).alias("score"))
