import pytest

#: Rows that every operator must take: nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
    (1, "another text under the same id", None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, "   \n\t ", "de", ""),
    (None, "a text without an id", "en", "a"), (None, None, None, None), (5, "word " * 40_000, "en", "a"), (6, "x" * 300_000, "fr", "b"),
    (7, "é中\U0001f600 \x00\x1c!", "zz", "b"), (8, "12 34 !!", "en", "a"), (-9, "neg ative", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows, and extra columns whose names clash with what the operators use."""
    rows = [(i, t, lang, s, len(t or ""), "x", 1, None) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash string, removed int, row string").withColumnRenamed("row", "a.b")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
