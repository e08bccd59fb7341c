import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _t string, row string, fp string, digest string, shard string, n string, h string, keep_id string"
LONG = " ".join(f"wort{i % 977} und so" for i in range(60_000))
ROWS = [
    (1, "One text here. It has a few words to compare.\nAnd a second line of more than five words."),
    (2, "One  text here.\tIt has a few words to compare.\n\nAnd a second line of more than five words. "),
    (3, None), (4, ""), (5, " \n\t "), (6, "word"), (6, "word"), (7, "word"), (7, "other words under one id"), (None, "a text without an id, quite alone"),
    (None, None), (8, LONG), (9, LONG), (10, "ünïcödé – 中文 😀 <|endoftext|> don't  stop\x1c\x85x"), (11, "12345 67890 !!! ---"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns whose names operators might use."""
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, 1, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
