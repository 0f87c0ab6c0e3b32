"""Rows that every operator has to survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    *(T.StructField(n, T.StringType()) for n in ("word", "n", "fp", "score", "kept", "label", "toxic", "quality", "spans", "component_id", "rep", "key")),
])

TEXTS = [None, "", " ", "\n\t", "a", "a b c", "a b c", "a b c d e f", "A B C D E F", "\x00 \x85\xa0 İ ſ K", "x" * 70_000, "wörd çé " * 9_000, "12 " * 400, "<|endoftext|> x <|endoftext|>", "日本語 テキスト 😀"]


def rows():
    out = [(i, t, "en", "s", None, *["z"] * 12) for i, t in enumerate(TEXTS)]
    out += [(None, "a b c", None, None, None, *[None] * 12), (5, "a b c", "en", "s", 5, *["z"] * 12), (5, "a b c", "en", "s", 5, *["z"] * 12)]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
