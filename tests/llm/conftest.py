import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, and columns whose names clash with the operators' own."""
    rows = [
        (1, "the first text of all, with some words in it", "en", "a", 10),
        (1, "the first text of all, with some words in it", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "de", "b", 4),
        (None, "a text without an id that says token = abcdef123456", "en", "a", 5),
        (None, None, None, None, None),
        (5, LONG, "fr", "c", len(LONG)),
        (6, "the first text of all, with some words in it", "es", "a", 10),
        (7, "ends with a break\n", "en", "a", 10),
        (7, "another text under the same id here", "en", "a", 10),
        (8, "é😀 ▁ \x00 \x0b odd  characters\r\n", "en", "a", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "component_id", "row", "bucket", "g", "score", "removed", "kept_text", "token_ids", "rate", "domain", "_key", "key", "label", "copy", "secret_spans", "n", "pos", "quality", "spans", "_id", "_copy", "_spans", "_rules", "_rate", "again", "place", "tokens"):
        df = df.withColumn(name, df["n_chars"])
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
