"""Small helpers shared by the operators: tables, written stages, shared files."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.testdata import table

__all__ = ["shared_path", "small_batches", "table", "texts", "written", "file_system"]

#: White space of the token contracts: space and \t \n \v \f \r.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so a
    lost executor costs a re-read, and later steps read only their columns."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside passes texts to Python by ``rows`` at a time: a task and its
    worker then hold a few MB of text each, not 10,000 texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the named columns only, so
    that extra columns of any name cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder, opened inside a task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)
                                  if "://" in uri or uri.startswith("file:") else f"file://{uri}")
