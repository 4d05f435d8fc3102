"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import re

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("_part", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("_key", T.StringType()), T.StructField("node", T.StringType()), T.StructField("score", T.DoubleType()),
])


def documents(spark, rows):
    """``rows``: (doc_id, text[, lang, source]); the other columns clash with names that operators use."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), None, "x", "y", 1, None, "n", 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_texts():
    """Null, empty, blank, very long, equal and near equal texts."""
    base = " ".join(f"word{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, base.replace(" ", "\n")), (7, base + " tail"), (8, "one"), (9, "a b"), (10, "é ü\x0bß"),
        (11, " ".join(["long"] * 30_000)), (12, base.upper()), (13, None), (None, "no id"), (14, "x" * 5000), (15, base.replace("word30", "other")),
    ]


def words(text):
    return WORDS.findall(text or "")
