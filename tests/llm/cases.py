"""Awkward documents: nulls in every column, empty and very long texts, ties, repeated rows, columns that clash."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHING = ["name", "level", "copies", "keep_id", "sha", "ids", "bytes", "score", "predicted", "_text", "_topic", "_source", "_lang", "_tokens",
            "_probability", "n", "rep", "component_id", "_llm_sha", "_llm_id", "_llm_score", "_row", "key", "sig", "kept", "tokens", "weight"]
LONG = "the cat sat on a mat; " * 9_000


def rows():
    return [
        (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g ", "en", "s", 14),
        (4, None, "en", "s", None), (5, "", None, "s", 0), (6, " \n\t", "en", None, 3), (7, LONG, "de", "s", 0), (8, LONG, "de", "t", 0),
        (9, LONG + "x", "de", "t", 0), (None, "a b c d e f g", "en", "s", 1), (10, "twice told", "en", "s", 10), (10, "twice told", "en", "s", 10),
        (11, "one", None, None, None), (None, None, None, None, None),
    ]


def documents(spark, more=()):
    frame = spark.createDataFrame([*rows(), *more], SCHEMA)
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def none(spark):
    return documents(spark).limit(0)


def without_clash(frame):
    return frame.select("doc_id", "text", "lang", "source", "n_chars")
