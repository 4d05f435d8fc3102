"""A stored gram index: postings of distinct names clustered by gram, updated by deltas.

Layout below one folder: ``postings/version=V`` holds (gram, name_lower, removed) and ``counts/version=V``
(gram, names), both sorted by gram, so that a filter on grams reads the row groups of these only. Version 0 is the
whole catalog, later ones what changed; the newest row of a (gram, name) wins, and counts are summed. A gram that
every name has is spread over many files, because files are ranges of (gram, name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.functions.paths import strip
from pathmere.operators.grams import grams

#: Rarest grams of a term that are intersected.
PROBES = 3
#: Grams that are pushed to the scan as a filter; more are joined.
PUSHED = 200
POSTINGS = "gram string, name_lower string, removed boolean, version long"
COUNTS = "gram string, names long, version long"


def _write(rows: DataFrame, folder: str, version: int, files: int | None) -> None:
    """``rows``: name_lower, removed; each gram of each name, and by how much its number of names changes."""
    ranges = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.select(F.explode(grams(F.col("name_lower"))).alias("gram"), "name_lower", "removed")
    listed.repartitionByRange(ranges, "gram", "name_lower").sortWithinPartitions("gram", "name_lower").write.mode("overwrite").parquet(f"{folder}/postings/version={version}")
    back = rows.sparkSession.read.schema(POSTINGS).parquet(f"{folder}/postings/version={version}")
    change = back.groupBy("gram").agg(F.sum(F.when(F.col("removed"), -1).otherwise(1)).alias("names"))
    change.repartitionByRange(max(1, ranges // 8), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts/version={version}")


def build_index(catalog: DataFrame, folder: str, files: int | None = None) -> None:
    """Index of all names of a catalog."""
    names = catalog.select(F.lower("name").alias("name_lower"), F.lit(False).alias("removed")).distinct()
    _write(names, folder, 0, files)


def _wanted(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` for the grams of ``keys``; few grams become a filter that the scan sees."""
    few = [r["gram"] for r in keys.select("gram").distinct().limit(PUSHED + 1).collect()]
    if not few:
        return table.where(F.lit(False))
    if len(few) <= PUSHED:
        return table.where(reduce(lambda a, b: a | b, (F.col("gram") == g for g in sorted(few))))
    return table.join(keys.select("gram").distinct(), "gram", "left_semi")


def _postings(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    rows = _wanted(spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), keys)
    return rows.groupBy("gram", "name_lower").agg(F.max_by("removed", "version").alias("removed")).where("not removed").drop("removed")


def chosen_grams(spark: SparkSession, folder: str, terms: DataFrame, probes: int = PROBES) -> DataFrame:
    """``(query_id, term, gram, of)``: the rarest grams of each term, ``of`` how many; terms with an unseen gram drop out."""
    keys = terms.select("query_id", "term", F.explode(grams(F.lower(strip(F.col("term"))))).alias("gram"))
    counts = _wanted(spark.read.schema(COUNTS).parquet(f"{folder}/counts"), keys).groupBy("gram").agg(F.sum("names").alias("names")).where("names > 0")
    found = keys.join(counts, "gram", "left").groupBy("query_id", "term").agg(
        F.bool_and(F.col("names").isNotNull()).alias("seen"), F.slice(F.array_sort(F.collect_list(F.struct("names", "gram"))), 1, probes).alias("rare"),
    )
    return found.where("seen").select("query_id", "term", F.explode("rare.gram").alias("gram"), F.size("rare").alias("of"))


def matching_names(spark: SparkSession, folder: str, terms: DataFrame, probes: int = PROBES) -> DataFrame:
    """``(query_id, term, name_lower)`` for terms (query_id, term) of three or more characters."""
    chosen = chosen_grams(spark, folder, terms, probes)
    met = chosen.join(_postings(spark, folder, chosen), "gram").groupBy("query_id", "term", "name_lower").agg(F.count("*").alias("n"), F.first("of").alias("of"))
    return met.where((F.col("n") == F.col("of")) & F.contains(F.col("name_lower"), F.lower(strip(F.col("term"))))).drop("n", "of")


def substring_search(catalog: DataFrame, folder: str, terms: DataFrame) -> DataFrame:
    """Records whose name contains a term, with ``query_id`` and ``term``; equal to a plain contains filter."""
    hits = matching_names(catalog.sparkSession, folder, terms)
    return catalog.withColumn("name_lower", F.lower("name")).join(hits, "name_lower").drop("name_lower")


def update_index(catalog: DataFrame, touched: DataFrame, folder: str, version: int, files: int | None = None) -> None:
    """Bring the index up to the catalog as it is now, for the ``touched`` names (name_lower) only.

    Names that are there already, or are gone already, change nothing. A version written again
    replaces itself.
    """
    spark = catalog.sparkSession
    names = touched.select("name_lower").distinct()
    now = catalog.select(F.lower("name").alias("name_lower")).join(names, "name_lower", "left_semi").distinct().withColumn("there", F.lit(True))
    # one gram of a name tells whether it is listed
    first = names.select("name_lower", F.get(grams(F.col("name_lower")), F.lit(0)).alias("gram")).where("gram is not null")
    earlier = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("version") < version)
    listed = _wanted(earlier, first).join(first, ["gram", "name_lower"], "left_semi").groupBy("name_lower").agg(F.max_by("removed", "version").alias("gone")).where("not gone")
    state = first.join(now, "name_lower", "left").join(listed, "name_lower", "left")
    changed = state.where(F.col("there").isNotNull() != F.col("gone").isNotNull())
    _write(changed.select("name_lower", F.col("there").isNull().alias("removed")), folder, version, files)


def compact_index(spark: SparkSession, folder: str, target: str, files: int | None = None) -> None:
    """The same index without history, in another folder."""
    rows = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").groupBy("gram", "name_lower").agg(F.max_by("removed", "version").alias("removed"))
    _write(rows.where("not removed").select("name_lower", "removed").distinct(), target, 0, files)
