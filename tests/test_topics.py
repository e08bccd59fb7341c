"""The vectorizer of the topics against Spark ML's fit on every pair of words."""

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from cohortlens.operators import text as T


def _texts(spark, counts):
    """Texts with each word as often as told, in an order of its own; the first two words always side by side."""
    a, b, *rest = counts
    rows = ["alpha beta " * min(a, b) + "alpha " * (a - min(a, b))] + [f"{w} " * n for w, n in zip(("gamma", "delta", "epsilon", "zetas"), rest)]
    return T.tokens(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2, "doc_id"), "text", ["doc_id"])


def _fitted(tok, size):
    grams = tok.select("doc_id", F.concat(F.col("tokens"), T.ngrams(F.col("tokens"), 2)).alias("terms"))
    return CountVectorizer(inputCol="terms", outputCol="features", vocabSize=size).fit(grams), grams


def test_vocabulary_is_spark_mls_without_its_fit(spark, monkeypatch):
    tok = _texts(spark, (9, 14, 21, 31, 41))
    want = _fitted(tok, 5)[0].vocabulary
    monkeypatch.setattr(CountVectorizer, "fit", lambda *a: 1 / 0)
    assert T._vectorizer(tok, "doc_id", 5).vocabulary == want


def test_equal_totals_are_settled_as_before(spark):
    tok = _texts(spark, (9, 9, 21, 21, 41)).coalesce(1)
    assert T._vectorizer(tok, "doc_id", 5).vocabulary == _fitted(tok, 5)[0].vocabulary


def test_topics_are_those_of_all_terms(spark, monkeypatch):
    tok = _texts(spark, (9, 14, 21, 31, 41))
    seen, cut = [], T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda d: (seen.append(cut(d)), seen[-1])[1])
    T.topics(tok, "doc_id", n_texts=10, vocab=6, max_iter=1).collect()
    model, grams = _fitted(tok, 6)
    assert [r[0] for r in seen[0].collect()] == [r[0] for r in model.transform(grams).select("features").collect()]


def test_stop_words_and_short_words_go_in_one_filter(spark):
    df = spark.createDataFrame([(1, "The VIRUS of 2020, of an  old-study ab"), (2, None), (3, "of the an of the"), (4, "short")], "doc_id long, text string")
    assert [tuple(r) for r in T.tokens(df, "text", ["doc_id"], stop=("THE", "of")).collect()] == [(1, ["virus", "oldstudy"])]
