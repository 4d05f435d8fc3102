"""Whole-catalog statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmere.functions.alias import HAN, alias_need
from pathmere.functions.formats import with_format_info
from pathmere.functions.paths import volume_of


def _metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(F.lit(name).alias("metric"), "value")


def corpus_profile(catalog: DataFrame) -> DataFrame:
    """(metric, value) rows: directories, references, extra hard links, repeated and Han names.

    A reference names a file of its volume only, so links are counted by volume and reference.
    """
    volume = volume_of(F.col("full_path")).alias("volume")
    refs = catalog.where("file_reference <> 0").groupBy(volume, "file_reference").agg(F.count("*").alias("n"))
    names = catalog.groupBy(F.lower("name").alias("name_lower")).agg(F.count("*").alias("n"))
    parts = [
        _metric(catalog, "records", F.count("*")),
        _metric(catalog, "directories", F.count_if("is_directory")),
        _metric(catalog, "nonzero_references", F.count_if(F.col("file_reference") != 0)),
        _metric(refs, "extra_hard_links", F.sum(F.col("n") - 1)),
        _metric(refs, "extra_hard_link_rate", F.sum(F.col("n") - 1) / F.sum("n")),
        _metric(names, "repeated_names", F.sum(F.when(F.col("n") > 1, F.col("n")))),
        _metric(catalog, "han_names", F.count_if(F.col("name").rlike(HAN))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def alias_storage(names: DataFrame) -> DataFrame:
    """Characters stored when every name is kept with its aliases, against aliases alone.

    ``names``: name, search_text.
    """
    own = F.length(F.lower(F.trim("name")))
    extra = F.length("search_text")
    before = F.sum(own + F.when(extra > 0, extra + 1).otherwise(0))
    return names.agg(
        F.count("*").alias("n"),
        F.count_if(alias_need(F.col("name")) != "none").alias("names_with_need"),
        before.alias("chars_before"),
        F.sum(extra).alias("chars_after"),
    )


def format_census(catalog: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Files and bytes per format category."""
    files = catalog.where("not is_directory")
    return (
        with_format_info(files, formats)
        .groupBy("category")
        .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    )
