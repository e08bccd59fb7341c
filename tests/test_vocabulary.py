"""Frequent phrases by the bound of their words, against a plain count of all phrases; null texts; counted model rows."""

from collections import Counter

from cohortlens.operators import text as T

_WORDS = "alpha beta gamma delta".split()


def test_vocabulary_equals_plain_count_and_shuffles_few_phrases(spark):
    texts = [[_WORDS[(i * j) % 4] for j in range(9)] + [f"rare{i}", f"odd{i}"] for i in range(40)] + [["alpha"]]
    tok = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    every = Counter(" ".join(t[i:i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    for size in (1, 3, 10, 500):
        want = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:size]
        assert sorted((r["term"], r["total"]) for r in T.vocabulary(tok, "id", 3, size).collect()) == sorted(want)


def test_null_texts_are_left_out(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha beta"), (2, None), (3, "beta alpha beta gamma")], "id int, text string")
    got = T.count_vectors(T.tokens(df, "text", ["id"]), "id").collect()
    assert {r["id"] for r in got} == {1, 3}
