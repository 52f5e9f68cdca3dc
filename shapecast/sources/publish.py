"""Publishing as one commit.

Every table of a run is written to a folder of its own (``sets/<name>``), read
back and checked there. Only then is the file ``CURRENT`` replaced by one rename;
readers follow it. A check that fails, or a run that breaks anywhere before the
rename, leaves the set readable that was published before; two runs cannot mix.
Publishing the same tables again gives a set of the same rows. A set that no
reader uses any more can be deleted as a folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history_io import _exists, write_parquet

CURRENT = "CURRENT"


class ChecksFailed(RuntimeError):
    """The run's checks did not all pass; nothing was published."""


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under a temporary name and renames it over ``path``
    through Hadoop's FileContext, whose rename replaces a file in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(new, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, target, options)


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published now: the set's name and each table's row count; None: nothing yet."""
    path = f"{root}/{CURRENT}"
    if not _exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the set published now."""
    now = manifest(spark, root)
    if now is None or table not in now["tables"]:
        raise KeyError(f"{table} is not published under {root}")
    return spark.read.parquet(f"{root}/sets/{now['set']}/{table}")


def counts(spark: SparkSession, root: str) -> DataFrame:
    """table_name, row_count of the set published now."""
    now = manifest(spark, root)
    rows = sorted(now["tables"].items()) if now else []
    return spark.createDataFrame([(t, n) for t, n in rows], "table_name string, row_count long")


def publish_set(tables: dict[str, DataFrame], root: str, checks=None) -> dict:
    """Writes ``tables`` and makes them the published set; its manifest.

    ``checks``: takes the staged tables (read back from what was written) and
    gives rows (check, ok, detail); they are written with the set as
    ``run_checks``. If one is not ok, ``ChecksFailed`` is raised and the set is
    not published."""
    spark = next(iter(tables.values())).sparkSession
    name = uuid.uuid4().hex
    staged, sizes = {}, {}
    for table, df in tables.items():
        path = f"{root}/sets/{name}/{table}"
        write_parquet(df, path)
        staged[table] = spark.read.schema(df.schema).parquet(path)
        sizes[table] = staged[table].count()
    if checks is not None:
        path = f"{root}/sets/{name}/run_checks"
        write_parquet(checks(staged), path)
        found = spark.read.parquet(path).collect()      # a row for each check
        failed = [r["check"] for r in found if not r["ok"]]
        if failed:
            raise ChecksFailed(f"{len(failed)} check(s) failed, nothing published: {', '.join(sorted(failed))}")
        sizes["run_checks"] = len(found)
    now = {"set": name, "tables": sizes}
    _replace(spark, f"{root}/{CURRENT}", json.dumps(now))
    return now
