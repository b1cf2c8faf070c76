import pytest

LONG = " ".join(f"word{i % 701} and{i % 13}," for i in range(6000))
TEXTS = [
    None, "", " ", "\n", "one", "Same line\nother words here", "same LINE \nmore words there", LONG, "don't <|endoftext|> stop\n\n  two  spaces\there", "naïve café — 日本語 😀 ½ Ⅷ",
    "copy of a text with more than five words in it", "copy of a text with more than five words in it", "x" * 5000, "'s 'll 're've it's\r\nA\x0b\x0c b",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en", None if i % 3 else "s", 7, 1.5, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here at all", None, None, None, None, None), (None, None, None, None, None, None, None), (3, "another text under an id that is taken", "de", "s", 1, 2.0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
