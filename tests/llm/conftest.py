import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta", "en", "s"), (1, "Alpha beta gamma delta epsilon zeta", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "   \n\t ", "en", None),
    (None, "no id here at all", "en", "s"), (5, "word", "fr", "t"), (6, "<|endoftext|> 'll  naïve ½ 中文 🙂", "en", "t"), (7, "x" * 30_000, "en", "t"), (8, "stupid " * 3 + "tail", "en", "t"), (9, "Alpha beta gamma delta epsilon zeta", "de", "u"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that operators might use themselves."""
    rows = [(*r, 7, 0.5, "x", 3) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string, shard int").cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").cache()
