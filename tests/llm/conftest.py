import pytest
from pyspark.sql import types as T

LONG = "palabra larga ñandú " * 4000
PASSAGE = "this passage of more than one hundred bytes stands in several documents, word for word, and only its first place stays where it is."

#: doc_id, text: nulls, empty and blank texts, ties, repeated rows, one id with two texts, very long texts.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one"),
    (7, "ONE"),
    (None, "a document without an id but with some text in it"),
    (None, None),
    (8, LONG),
    (9, LONG + " end"),
    (10, "alpha. " + PASSAGE + " omega"),
    (11, "beta! " + PASSAGE + " psi"),
    (12, PASSAGE),
    (13, "and " * 300),
    (14, "x" * 5000),
    (15, "line one 1\nline two 22  \n\n<|endoftext|> after é \x1c ½ 　z"),
    (15, "another text of document fifteen"),
    (16, "12 345 ... !!"),
]


@pytest.fixture(scope="session")
def table(spark):
    """The rows with columns whose names clash with those the operators use inside."""
    extra = ["key", "shard", "_id", "_key", "_gone", "line", "text_", "dg", "n", "row", "score"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(c, T.StringType()) for c in extra)])
    langs = ["en", "en", None, "en", "es", "es", "es", "en", "en", "en", "es", "es", "en", "en", "en", "en", "en", "es", "en", None]
    return spark.createDataFrame([(i, t, g, *(["?"] * len(extra))) for (i, t), g in zip(ROWS, langs, strict=True)], schema)


@pytest.fixture(scope="session")
def nothing(table):
    return table.filter("false")
