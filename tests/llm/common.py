"""A small documents table with the awkward cases: nulls, empty and long texts, ties, repeated rows."""

from pyspark.sql import functions as F

ODD = [
    (0, "alpha beta\n\ngamma <|endoftext|> delta", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, "  spaced   out\ttext ", "en"),
    (4, "Ωmega ​zero naïve 日本語 ½ x²", "fr"),
    (None, "text without an id", "en"),
    (5, "word " * 9000, "en"),
    (6, "same text", "en"),
    (6, "same text", "en"),
    (7, "same text", "en"),
]


def odd(spark):
    """With further columns whose names clash with those of the operators' results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in ("start", "length", "n_tokens", "tier", "n_words", "component_id", "kept", "spans", "labels", "shard")})


def empty(spark):
    return odd(spark).filter("false")
