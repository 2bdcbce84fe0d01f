import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names could clash."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [
        (1, "Some plain text about nothing much at all.", "en", "a", 42),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "A text without an id, which is legal.", None, "b", 5),
        (4, long, "en", "b", len(long)),
        (5, PASSAGE + "\nmore", "en", "a", 1),
        (6, "other line\n" + PASSAGE, "en", "c", 1),
        (6, "other line\n" + PASSAGE, "en", "c", 1),
        (7, "   \n\t\n", "xx", "", 1),
        (8, "ß É 漢字 \U0001d5c5 token = abcdefgh", "de", "a", 9),
        (9, "Some plain text about nothing much at all.", "en", None, 42),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_d", "_h", "_row", "rank", "size", "score", "toxicity", "copy_of", "start"):
        df = df.selectExpr("*", f"'{name}' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
