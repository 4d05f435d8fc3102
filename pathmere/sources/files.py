"""Reading folders, text files and Parquet descriptions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from pathmere.functions import paths as P


def plain_path(path: Column) -> Column:
    """Local paths without their ``file:`` scheme; other schemes keep it."""
    return F.regexp_replace(path, r"^file:/+", "/")


def plain_uri(uri: Column) -> Column:
    """Same for escaped file URIs, such as the metadata column of a scan."""
    decoded = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return plain_path(F.coalesce(decoded, uri))


def read_listing(spark: SparkSession, *roots: str) -> DataFrame:
    """Files below the roots: full_path, is_directory, size_bytes, mtime.

    Only file metadata is selected, so no content is read. Folders come from ``build_catalog``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return files.select(
        plain_path(F.col("path")).alias("full_path"),
        F.lit(False).alias("is_directory"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def read_text_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Decoded text of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return files.select(
        plain_path(F.col("path")).alias("full_path"),
        F.col("length").alias("size_bytes"),
        decode_text(F.col("content")).alias("text"),
    )


# --- byte decoding -----------------------------------------------------------------------

_MARKS = {"utf-8": "EFBBBF", "utf-16-le": "FFFE", "utf-16-be": "FEFF"}


def _starts(content: Column, mark: str) -> Column:
    return F.substring(content, 1, len(mark) // 2) == F.unhex(F.lit(mark))


def _latin(content: Column, size: int) -> Column:
    """The first bytes as characters 0 to 255."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def is_binary(content: Column | str) -> Column:
    """A zero byte, or more than one in twenty control bytes, at the start of the data; null for null."""
    content = F.col(content) if isinstance(content, str) else content
    head = _latin(content, 4096)
    controls = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0E-\x1F]"))
    return head.contains("\0") | (controls > F.floor(F.length(head) / 20))


def _wide(content: Column, offset: int) -> Column:
    """Three quarters of the first 128 byte pairs have a zero at this offset: UTF-16 without a mark."""
    pairs = F.least(F.floor(F.length(content) / 2), F.lit(128))
    whole = F.substring(_latin(content, 256), F.lit(1), (pairs * 2).cast("int"))
    zeros = F.regexp_count(F.regexp_replace(whole, r"(?s)(.)(.)", f"${offset + 1}"), F.lit(r"\x00"))
    return (F.length(content) >= 4) & (zeros * 4 >= pairs * 3)


def decode_text(content: Column | str) -> Column:
    """Text of a byte column: marks, UTF-16 guess, strict UTF-8, then GBK; null when binary.

    UTF-8 is read by expressions; only UTF-16, GBK and damaged texts are handed to Python.
    """
    content = F.col(content) if isinstance(content, str) else content
    marked = {name: _starts(content, mark) for name, mark in _MARKS.items()}
    body = F.when(marked["utf-8"], content.substr(F.lit(4), F.length(content))).otherwise(content)
    plain = ~(marked["utf-16-le"] | marked["utf-16-be"] | (~marked["utf-8"] & (_wide(content, 1) | _wide(content, 0))))
    binary = plain & ~marked["utf-8"] & is_binary(content)
    text = body.cast("string")
    simple = plain & ~binary & F.is_valid_utf8(text)
    rest = _decode_rest(F.when(~simple & ~binary, content))
    return F.when(simple, text).otherwise(rest)


def _decode(data: bytes | None) -> str | None:
    """What expressions leave: UTF-16 with or without a mark, GBK, damaged UTF-8 behind its mark."""
    if data is None:
        return None
    for name, mark in _MARKS.items():
        if data.startswith(bytes.fromhex(mark)):
            return data[len(mark) // 2 :].decode(name, "replace")
    pairs = min(len(data) // 2, 128)
    for name, offset in (("utf-16-le", 1), ("utf-16-be", 0)):
        if len(data) >= 4 and data[offset : pairs * 2 : 2].count(0) * 4 >= pairs * 3:
            return data.decode(name, "replace")
    return data.decode("gbk", "replace")


@F.pandas_udf(StringType())
def _decode_rest(content: pd.Series) -> pd.Series:
    return content.map(_decode)


# --- Parquet -----------------------------------------------------------------------------

def describe_parquet(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Schema nodes (position, name, type, depth) and row counts per file."""
    df = spark.read.parquet(*paths)
    nodes: list[tuple[int, str, str, int, bool]] = []

    def visit(struct: StructType, prefix: str, depth: int) -> None:
        for field in struct.fields:
            name = f"{prefix}{field.name}"
            nodes.append((len(nodes), name, field.dataType.simpleString(), depth, field.nullable))
            inner = field.dataType
            while isinstance(inner, ArrayType):
                inner = inner.elementType
            if isinstance(inner, StructType):
                visit(inner, name + ".", depth + 1)

    visit(df.schema, "", 0)
    schema = spark.createDataFrame(nodes, "position int, name string, type string, depth int, nullable boolean")
    counts = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("row_count"))
    return schema, counts.withColumn("file_path", plain_uri(F.col("file_path")))


def file_name(path: Column) -> Column:
    return P.name_of(path)
