"""Text mining over a table of texts: tokens, term counts, topics, sentiment, phrases, gap phrases, co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage, stored

col, lit = F.col, F.lit

# English stop words.
ENGLISH = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())
# Words of the domain that carry no information.
DOMAIN = ("covid", "covid-19", "coronavirus", "sars", "cov", "patient", "patients", "study", "studies", "research", "analysis",
          "data", "results")
# Phrases that announce a gap in knowledge.
GAP_PHRASES = (
    "limited", "unclear", "unknown", "needs further", "future research", "not well understood", "requires investigation",
    "gaps in knowledge", "insufficient data", "lack of evidence", "more studies needed",
)
# word, polarity, subjectivity: a small default; callers pass their own lexicon table.
LEXICON = (
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("effective", 0.6, 0.8), ("improved", 0.5, 0.5), ("safe", 0.5, 0.5), ("significant", 0.4, 0.9),
    ("successful", 0.75, 0.95), ("useful", 0.3, 0.0), ("best", 1.0, 0.3), ("better", 0.5, 0.5), ("bad", -0.7, 0.67), ("poor", -0.4, 0.6),
    ("severe", -0.5, 0.6), ("worse", -0.4, 0.6), ("worst", -1.0, 1.0), ("unclear", -0.3, 0.5), ("limited", -0.1, 0.15), ("worthless", -0.8, 0.9),
    ("stupid", -0.8, 1.0), ("useless", -0.5, 0.2), ("hate", -0.8, 0.9), ("terrible", -1.0, 1.0),
)
LEMMAS = (("outcomes", "outcome"), ("treatments", "treatment"), ("factors", "factor"), ("risks", "risk"), ("cases", "case"), ("trials", "trial"))


def _words(c: Column) -> Column:
    """Runs of letters, and empty texts at the ends."""
    return F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""), r"\s+")


def _clean_tokens(c: Column) -> Column:
    return F.filter(_words(c), lambda x: x != "")


def tokens(df: DataFrame, text: str, keep: Sequence[str], stop: Sequence[str] = ENGLISH + DOMAIN, min_len: int = 3, min_chars: int = 10) -> DataFrame:
    """``keep`` columns and ``tokens``: lower-case letter words without stop words and short words, of texts with at least
    ``min_chars`` characters."""
    # One filter of the words as they stand: letters in lower case.
    low = sorted({w.lower() for w in stop})
    good = lambda x: (F.length(x) >= max(1, min_len)) & ~x.isin(*low)
    words = F.filter(_words(col(text)), good if low else lambda x: F.length(x) >= max(1, min_len))
    out = df.where(F.length(text) >= min_chars).select(*keep, words.alias("tokens"))
    return out.where(F.size("tokens") > 0)


def word_tokens(df: DataFrame, text: str, keep: Sequence[str], stop: Sequence[str] = ENGLISH) -> DataFrame:
    """``keep`` columns and ``tokens``: lower-case runs of two or more letters, digits or ``_`` without stop words, of all texts."""
    raw = df.select(*keep, F.regexp_extract_all(F.lower(text), lit(r"[\p{L}\p{N}_]{2,}"), lit(0)).alias("_raw"))
    return raw.select(*keep, F.filter("_raw", lambda w: ~w.isin(*stop)).alias("tokens")).where(F.size("tokens") > 0)


def preprocess(df: DataFrame, text: str, key: str) -> DataFrame:
    return tokens(df, text, [key]).select(key, F.concat_ws(" ", "tokens").alias("processed"))


def lemmatize(tok: DataFrame, key: str, lemmas: Sequence[tuple[str, str]] | DataFrame = LEMMAS) -> DataFrame:
    """Tokens replaced by their dictionary lemma, order kept. A dictionary given as a table is joined without a hint."""
    words = tok.select(key, F.posexplode("tokens").alias("pos", "word"))
    if isinstance(lemmas, DataFrame):
        d = lemmas
    else:
        d = F.broadcast(tok.sparkSession.createDataFrame(list(lemmas), "word string, lemma string"))
    out = words.join(d, "word", "left").select(key, F.struct("pos", F.coalesce("lemma", "word").alias("w")).alias("t"))
    # A group is one text.
    return out.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["w"]).alias("tokens"))


def ngrams(tok: Column, n: int) -> Column:
    if n == 1:
        return tok
    starts = F.when(F.size(tok) >= n, F.sequence(lit(1), F.size(tok) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tok, i, n)))


def term_rows(tok: DataFrame, key: str, max_n: int) -> DataFrame:
    grams = F.concat(*[ngrams(col("tokens"), n) for n in range(1, max_n + 1)])
    return tok.select(key, F.explode(grams).alias("term"))


def vocabulary(tok: DataFrame, key: str, max_n: int, size: int) -> DataFrame:
    """The ``size`` most frequent terms, ties by term.

    A phrase is no more frequent than any of its words, so phrases are counted only where every word has the total of the
    word in place ``size``, or more; with fewer words, all are.
    """
    ranked = lambda t: t.orderBy(col("total").desc(), "term").limit(size)
    words = tok.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(lit(1)).alias("total"))
    if max_n == 1:
        return ranked(words)
    words = stored(words, "words")
    least = ranked(words).agg(F.when(F.count(lit(1)) == size, F.min("total")).otherwise(lit(0)).alias("_least"))
    often = stored(words.join(F.broadcast(least)).where(col("total") >= col("_least")).select("term", "total"), "often")
    out = often
    for n in range(2, max_n + 1):
        w = [f"w{i}" for i in range(n)]
        runs = F.arrays_zip(*[F.slice("tokens", i + 1, F.size("tokens")).alias(c) for i, c in enumerate(w)])
        grams = tok.select(F.explode(runs).alias("g")).select("g.*")
        for c in w:
            # A run beyond the end has a null and joins nothing.
            grams = grams.join(often.select(col("term").alias(c)), c)
        out = out.unionByName(grams.groupBy(*w).agg(F.count(lit(1)).alias("total")).select(F.concat_ws(" ", *w).alias("term"), "total"))
    return ranked(out)


def count_vectors(tok: DataFrame, key: str, max_n: int = 2, size: int = 100) -> DataFrame:
    """Sparse term counts ``key, term, n`` over the vocabulary. The vocabulary has ``size`` rows, so terms outside of it
    are dropped before anything is shuffled."""
    vocab = vocabulary(tok, key, max_n, size).select("term")
    return term_rows(tok, key, max_n).join(F.broadcast(vocab), "term").groupBy(key, "term").agg(F.count(lit(1)).alias("n"))


def _vectorizer(tok: DataFrame, key: str, size: int) -> CountVectorizerModel:
    """Spark ML's vectorizer of words and pairs of words, its ``size`` terms the most frequent first.

    Where the totals tell all places apart, the vocabulary gives them. Equal totals leave places open, which weigh in what is
    learned from them; then Spark ML counts every pair and settles them as ever.
    """
    top = vocabulary(tok, key, 2, size + 1).select("term", "total").collect()  # at most ``size`` + 1
    if top and len({r["total"] for r in top}) == len(top):
        return CountVectorizerModel.from_vocabulary([r["term"] for r in sorted(top, key=lambda r: -r["total"])[:size]], inputCol="terms", outputCol="features")
    grams = tok.select(F.concat(col("tokens"), ngrams(col("tokens"), 2)).alias("terms"))
    return CountVectorizer(inputCol="terms", outputCol="features", vocabSize=size).fit(grams)


def topics(tok: DataFrame, key: str, n_texts: int | None = None, vocab: int = 100, seed: int = 42, max_iter: int = 10) -> DataFrame:
    """``topic_id, rank, word, weight``: LDA with min(5, texts / 2) topics and ten words each."""
    n = n_texts if n_texts is not None else min(10, tok.count())
    k = max(2, min(5, n // 2))
    cv = _vectorizer(tok, key, vocab)
    words = list(cv.vocabulary)  # at most ``vocab``
    # Other terms go before they are counted: no phrase is made of a word that no term begins or ends with.
    part = lambda at: list({w.split(" ")[at] for w in words if " " in w})
    pairs = F.arrays_zip(F.slice("tokens", 1, F.size("tokens") - 1).alias("a"), F.slice("tokens", 2, F.size("tokens")).alias("b"))
    phrases = F.transform(F.filter(pairs, lambda p: p["a"].isin(part(0)) & p["b"].isin(part(1))), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    terms = F.concat(*[F.filter(t, lambda x: x.isin(words)) for t in (col("tokens"), phrases)])
    # Every iteration reads the vectors: they are made once, in the rows' own order and partitions.
    vectors = cut_lineage(cv.transform(tok.select(terms.alias("terms"))).select("features"))
    model = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online").fit(vectors)
    top = model.describeTopics(10)
    look = F.array(*[lit(w) for w in words])  # at most ``vocab`` words
    return top.select(col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t")).select(
        "topic_id", "rank", F.element_at(look, col("t.termIndices") + 1).alias("word"), col("t.termWeights").alias("weight"))


def lexicon_table(spark, rows: Sequence[tuple[str, float, float]] = LEXICON) -> DataFrame:
    return spark.createDataFrame(list(rows), "word string, polarity double, subjectivity double")


def sentiment(df: DataFrame, text: str, key: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each text; only hits leave the scan."""
    base = df.where(F.length(text) >= 10)
    words = base.select(key, F.explode(_clean_tokens(col(text))).alias("word"))
    lex = F.broadcast(lexicon_table(df.sparkSession)) if lexicon is None else lexicon
    hits = words.join(lex, "word").groupBy(key).agg(F.avg("polarity").alias("p"), F.avg("subjectivity").alias("s"))
    score = F.coalesce("p", lit(0.0))
    return base.select(key, F.length(text).alias("text_length")).join(hits, key, "left").select(
        key, "text_length", score.alias("sentiment_score"), F.coalesce("s", lit(0.0)).alias("subjectivity"),
        F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("sentiment_label"))


def sentiment_summary(scores: DataFrame) -> DataFrame:
    lab = col("sentiment_label")
    return scores.agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.avg("subjectivity").alias("avg_subjectivity"),
        *[F.count_if(lab == x).alias(x) for x in ("positive", "neutral", "negative")])


def key_phrases(df: DataFrame, text: str, key: str, kept: int = 50, top_n: int = 20, stop: Sequence[str] = ENGLISH) -> DataFrame:
    """Most frequent 1-3-grams. With one combined document the inverse document frequency is constant, so the score is
    the count over the Euclidean norm of the ``kept`` counts."""
    top = vocabulary(word_tokens(df, text, [key], stop), key, 3, kept)
    norm = top.agg(F.sqrt(F.sum(col("total").cast("double") * col("total"))).alias("_n"))
    return top.join(F.broadcast(norm)).select(col("term").alias("phrase"), "total", (col("total") / col("_n")).alias("score")).orderBy(
        col("total").desc(), "phrase").limit(top_n)


def research_gaps(df: DataFrame, text: str, keep: Sequence[str], phrases: Sequence[str] = GAP_PHRASES) -> DataFrame:
    """One row per (text, phrase) hit with the context from 50 characters before to 100 after the first hit."""
    t = F.lower(text)
    hit = F.explode(F.filter(F.array(*[lit(p) for p in phrases]), lambda p: F.contains(t, p)))
    rows = df.select(*keep, col(text).alias("_t"), hit.alias("gap_indicator"))
    start = F.expr("instr(lower(_t), gap_indicator)") - 1
    lo = F.greatest(lit(0), start - 50)
    return rows.select(*keep, "gap_indicator", F.substr("_t", lo + 1, start + 100 - lo).alias("context"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("gap_indicator").agg(F.count(lit(1)).alias("n"))


def cooccurrence(df: DataFrame, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """Edges ``src, dst, weight`` between terms found (as substrings) in the same text.

    ``terms`` is a short list made by a top-n; it travels as one array, and a text gives at most all pairs of it.
    """
    listed = terms.agg(F.sort_array(F.collect_set(term)).alias("_terms"))
    # Each text is lower-cased once, not once a term.
    found = F.transform(F.array(F.lower(text)), lambda low: F.filter("_terms", lambda x: F.contains(low, x)))
    present = df.join(F.broadcast(listed)).select(F.get(found, lit(0)).alias("p"))
    return (
        present.select(F.posexplode("p").alias("i", "src"), "p")
        .select("src", F.explode(F.slice("p", col("i") + 2, F.size("p"))).alias("dst"))
        .groupBy("src", "dst").agg(F.count(lit(1)).alias("weight")))


def term_centrality(edges: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Degree centrality of every term, 0 for a term without an edge."""
    ends = edges.select(col("src").alias(term)).unionByName(edges.select(col("dst").alias(term)))
    deg = ends.groupBy(term).agg(F.count(lit(1)).alias("degree"))
    n = terms.agg(F.count(lit(1)).alias("_n"))
    return terms.select(term).join(deg, term, "left").join(F.broadcast(n)).select(
        term, F.coalesce("degree", lit(0)).alias("degree"), (F.coalesce("degree", lit(0)) / (col("_n") - 1)).alias("centrality"))

