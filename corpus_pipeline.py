"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

1. language ID: documents in none of the learned languages (no letter, or hardly an n-gram of any) go;
2. line dedup: later copies of repeated runs of lines are deleted, and documents of which nothing is left go;
3. SimHash near-dedup: one document of each group stays (smallest id, null last, then text hash); fingerprints of four-word
   shingles link at four or fewer differing bits;
4. benchmark decontamination: documents that hold a test item go;
5. BPE: token ids of each document, and the text decoded from them.

A row that repeats another's id and text shares its fate. Null and empty texts have no letter and go in the first stage;
texts are worked on whole, however long; an empty table stays empty. Columns beside those of documents, whatever their
names, pass through all stages but the last; ``n_chars`` is kept true where the table has it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, decontaminate, langid, line_dedup, simhash
from cohortlens.llm.frames import WS, keyed, same_doc
from cohortlens.session import stored

#: Least corrected share of n-grams, relative to a language's own texts, for a document to be in that language.
IN_LANGUAGE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= IN_LANGUAGE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.delete_repeated(docs)
    left = done.where((F.col("n_deleted") == 0) | (F.btrim("text", F.lit(WS)) != ""))
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    cut = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    row = F.when(F.col("n_deleted") == 0, F.col("row")).otherwise(cut)
    return left.select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, stay = keyed(docs), simhash.representatives(docs)
    return d.join(stay, same_doc(d, stay), "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.find_items(docs, items).select(F.col("doc_id").alias("_id"), "_t").distinct()
    d = keyed(docs)
    return d.join(leaks, same_doc(d, leaks), "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: Language prediction and BPE cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
