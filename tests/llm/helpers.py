"""Small tables with the rows that are easy to get wrong."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SENTENCE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak "
    "tree near the quiet river and count the stars that rise above the dark hills tonight"
)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, SENTENCE, "en", "a", 1),
        (2, SENTENCE.replace(" ", "  "), "en", "a", 1),
        (3, SENTENCE + " again", "en", None, None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n", "de", "b", 3),
        (None, SENTENCE, "en", "b", 1),
        (7, "word " * 30_000, "fr", "c", 150_000),
        (8, "x" * 50_000, "fr", "c", 50_000),
        (9, "für die Straße über Ärger, <|endoftext|> 123_45 … ß²", "de", "c", 50),
        (10, "one two", "en", "", 7),
        (10, "one two", "en", "", 7),
        (11, "!!! ???", "en", "a", 7),
        (12, SENTENCE, "en", "a", 1),
    ]


def odd_documents(spark):
    """The odd rows with extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), DOC_SCHEMA)
    extra = ("id", "score", "kept", "size", "key", "start", "length", "probability", "class", "shard", "_id", "_lost")
    return docs.withColumns({c: F.lit(c) for c in extra})


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
