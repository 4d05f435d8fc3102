"""Catalog generations on plain Parquet: write aside, then publish by pointer.

Layout below one folder: ``gen=N/attempt=…`` holds the rows, ``pointer`` an append-only table
(generation, path, row_count). Readers follow the newest pointer whose data is complete, so they
never see a half-written generation and fall back when the newest one is damaged. One writer.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmere.operators.catalog import write_catalog

#: Signs of missing or truncated files in an error.
DAMAGE = ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "FileNotFoundException", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "Could not read footer")
POINTER_SCHEMA = "generation long, path string, row_count long, batch_id long"


def save_snapshot(df: DataFrame, folder: str, generation: int, batch_id: int = -1) -> None:
    """Write a complete generation, count what was written, then publish it.

    A search catalog keeps the sorted layout of ``write_catalog``.
    """
    spark = df.sparkSession
    target = f"{folder}/gen={generation}/attempt={uuid.uuid4().hex}"
    if {"name", "search_text"} <= set(df.columns):
        write_catalog(df, target)
    else:
        df.write.parquet(target)
    rows = spark.read.parquet(target).count()
    pointer = spark.createDataFrame([(generation, target, rows, batch_id)], POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def pointers(spark: SparkSession, folder: str) -> DataFrame:
    """Published generations, newest first."""
    table = spark.read.schema(POINTER_SCHEMA).parquet(f"{folder}/pointer")
    return table.orderBy(F.col("generation").desc(), F.col("path"))


def published(spark: SparkSession, folder: str):
    """Newest pointer row with usable data, or None."""
    try:
        history = pointers(spark, folder)
        history.schema
        candidates = history.toLocalIterator()  # one row per generation, read one by one
        for pointer in candidates:
            if _complete(spark, pointer):
                return pointer
    except AnalysisException as error:
        if not any(mark in str(error) for mark in DAMAGE):
            raise
    return None


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest usable generation."""
    pointer = published(spark, folder)
    if pointer is None:
        raise FileNotFoundError(f"no usable generation below {folder}")
    return spark.read.parquet(pointer.path)


def _complete(spark: SparkSession, pointer) -> bool:
    """The row count recorded at publication still holds (read from file footers).

    Missing or truncated files make a generation unusable; any other error is raised, since an
    older generation must not stand in for a newer one that merely could not be read just now.
    """
    try:
        return spark.read.parquet(pointer.path).count() == pointer.row_count
    except Exception as error:
        if any(mark in str(error) for mark in DAMAGE):
            return False
        raise
