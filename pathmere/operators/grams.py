"""Substring search through three-letter grams, and the name dictionary behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions.paths import strip

SIZE = 3


def grams(text: Column) -> Column:
    """Distinct runs of three characters, empty for shorter text."""
    n = F.length(text)
    return F.when(
        n >= SIZE,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: F.substring(text, i, F.lit(SIZE)))
        ),
    ).otherwise(F.array().cast("array<string>"))


def name_dictionary(catalog: DataFrame) -> DataFrame:
    """Distinct lower-case names with the number of their records and first and last path."""
    return catalog.groupBy(F.lower("name").alias("name_lower")).agg(
        F.count("*").alias("records"), F.min("path_key").alias("first_path"), F.max("path_key").alias("last_path")
    )


def postings(names: DataFrame) -> DataFrame:
    """(gram, name_lower) rows: each gram once per distinct name."""
    return names.select("name_lower", F.explode(grams(F.col("name_lower"))).alias("gram"))


def gram_counts(names: DataFrame) -> DataFrame:
    return postings(names).groupBy("gram").agg(F.count("*").alias("names"))


def rarest_grams(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """The least frequent gram of each term (query_id, term); terms with an unseen gram drop out."""
    wanted = terms.select("query_id", "term", F.explode(grams(F.lower(strip(F.col("term"))))).alias("gram"))
    found = wanted.join(counts, "gram", "left")
    return (
        found.groupBy("query_id", "term")
        .agg(
            F.min_by("gram", F.struct("names", "gram")).alias("gram"),
            F.min("names").alias("names"),
            F.bool_and(F.col("names").isNotNull()).alias("_all"),
        )
        .where("_all")
        .drop("_all")
    )


def substring_search(catalog: DataFrame, terms: DataFrame) -> DataFrame:
    """Records whose name contains the term, for many terms of 3+ characters.

    Terms meet only the names that share their rarest gram; ``contains`` then decides, so the
    result equals a plain contains filter. Names are matched once and joined back to records.
    """
    names = catalog.select(F.lower("name").alias("name_lower")).distinct()
    index = postings(names)
    counts = index.groupBy("gram").agg(F.count("*").alias("names"))
    keyed = rarest_grams(terms, counts)
    hits = index.join(keyed, "gram").where(F.contains(F.col("name_lower"), F.lower(strip(F.col("term")))))
    return (
        catalog.withColumn("name_lower", F.lower("name"))
        .join(hits.select("query_id", "term", "name_lower"), "name_lower")
        .drop("name_lower")
    )
