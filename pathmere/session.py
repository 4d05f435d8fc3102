"""Session helpers: time zone, shared scratch space, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def use_utc(spark: SparkSession) -> SparkSession:
    """Instants are compared and printed in UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder would vanish together with the machine that wrote it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="pathmere-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs keep a short plan and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filter_once(df: DataFrame, columns: dict[str, Column], condition: Column) -> DataFrame:
    """Add costly columns, then keep rows by a condition on them.

    The optimizer pushes a filter below a projection by copying the expressions into it, so a
    costly column would be computed twice (and its inputs many times). A row marker, which is
    not deterministic, in the same projection keeps each column a single evaluation.
    """
    marked = df.withColumns({**columns, "_marker": F.monotonically_increasing_id()})
    return marked.where((F.col("_marker") >= 0) & condition).drop("_marker")
