"""Alias columns of a catalog: reading, initials and stored search text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmere.functions.alias import alias_need, latin_reading, search_text
from pathmere.functions.paths import chars


def with_alias_forms(
    df: DataFrame, readings: DataFrame | None = None, mode: str = "multilingual", name_col: str = "name"
) -> DataFrame:
    """Add ``reading``, ``initials`` and ``search_text``.

    ``mode`` is 'multilingual', 'chinese' or 'disabled'. ``readings`` (char, reading) spells Han
    characters; without it such names keep themselves as form. Only distinct names that contain
    Han characters are exploded and joined; every other row stays in one native projection.
    """
    if mode not in ("multilingual", "chinese", "disabled"):
        raise ValueError(f"unknown mode {mode!r}")
    name = F.col(name_col)
    latin = latin_reading(name, mode)
    if readings is None or mode == "disabled":
        out = df.withColumn("reading", latin).withColumn("initials", F.col("reading"))
    else:
        han = spell_han_names(df.select(name.alias("_han_name")), readings)
        out = (
            df.join(han, (name == F.col("_han_name")) & (alias_need(name) == "chinese"), "left")
            .withColumn("reading", F.coalesce("_reading", latin))
            .withColumn("initials", F.coalesce("_initials", "reading"))
            .drop("_han_name", "_reading", "_initials")
        )
    if mode == "disabled":
        return out.withColumn("search_text", F.lit(""))
    return out.withColumn("search_text", search_text(name, F.col("reading"), F.col("initials")))


def spell_han_names(names: DataFrame, readings: DataFrame) -> DataFrame:
    """Full reading and initials per distinct name with Han characters."""
    distinct = names.where(alias_need(F.col("_han_name")) == "chinese").distinct()
    spelled = readings.select(F.col("char").alias("_char"), F.lower("reading").alias("_spelling")).dropDuplicates(["_char"])
    letters = distinct.select("_han_name", F.posexplode(chars(F.col("_han_name"))).alias("_pos", "_char"))
    pieces = letters.join(spelled, "_char", "left").select(
        "_han_name",
        F.struct(
            "_pos",
            F.coalesce("_spelling", F.lower("_char")).alias("full"),
            F.coalesce(F.substring("_spelling", 1, 1), F.lower("_char")).alias("first"),
        ).alias("piece"),
    )
    # one group is one name, so its size is bounded by the length of a name
    ordered = pieces.groupBy("_han_name").agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return ordered.select(
        "_han_name",
        F.array_join(F.col("p.full"), "").alias("_reading"),
        F.array_join(F.col("p.first"), "").alias("_initials"),
    )
