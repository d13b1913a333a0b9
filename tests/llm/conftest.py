import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, repeats, and names that clash."""
    rows = [
        (1, "plain words that say a little, and then some more of them.", "en", "a", 58, 7),
        (1, "plain words that say a little, and then some more of them.", "en", "a", 58, 7),
        (None, "plain words that say a little, and then some more of them.", None, None, None, None),
        (None, None, None, None, None, None),
        (2, None, "en", "a", 0, 7),
        (3, "", "en", "a", 0, 7),
        (4, " \n\t ", "en", "a", 4, 7),
        (5, "word " * 40_000, "en", "a", 200_000, 7),
        (6, "é😀 ß\x00 a.b@c.de " * 30, "fr", "a", 10, 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
