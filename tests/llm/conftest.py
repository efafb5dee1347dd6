import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA line that is shared by many documents.\nEnd.", "en", "a"),
    (2, "  A LINE THAT is shared by many documents. \nAnother text entirely, with its own words.", "en", "a"),
    (3, "a line that is shared by many documents.\n\n", "en", "b"),
    (4, "", "en", "b"),
    (5, None, None, None),
    (6, "The quick brown fox jumps over the lazy dog.\nA line that is shared by many documents.\nEnd.", "en", "c"),
    (7, "ÄÖÜ straße, été — ça va?\tTab\x0bVT\x0cFF\rCR", "de", "c"),
    (7, "ÄÖÜ straße, été — ça va?\tTab\x0bVT\x0cFF\rCR", "de", "c"),
    (8, "word " * 30_000, "en", "a"),
    (None, "A line that is shared by many documents.", "fr", "a"),
    (9, " \n\t ", "fr", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, h1 long, n int, doc string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns whose names operators also use."""
    return spark.createDataFrame([(*row, len(row[1] or ""), "x", 1, 2, None, 3) for row in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
