import os

import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
# workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [
    os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH")]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the hunters today", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 0),
    (5, "one two", "en", None, 7),
    (6, "ONE  two", "en", "b", 8),
    (7, "x" * 200_000, "en", "b", 200_000),
    (8, "word " * 30_000, "en", "a", 150_000),
    (9, "ä b c 'tis we'll 12,5 \U0001F600́   end", "de", "c", 9),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the hunters today", "en", "a", 1),
    (None, "no id here but some words that stand for themselves in this row", "en", "a", 3),
    (11, "tabs\tand\nlines\nlines\nlines \n\n  spaces", "fr", "c", 3),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, odd white space, and columns with clashing names."""
    rows = spark.createDataFrame(EDGES, SCHEMA)
    return rows.selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS size", "3 AS score", "'y' AS spans", "4 AS token_ids")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
