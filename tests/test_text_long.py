"""Word lists of very long texts."""

import time

from cohortlens.operators import text


def test_word_tokens_of_a_long_text(spark):
    words = [f"w{i % 5000}" if i % 3 else "the" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "id int, t string")
    began = time.time()
    got = text.word_tokens(df, "t", ["id"]).first().tokens
    assert got == [w for w in words if w != "the"]
    assert time.time() - began < 20
