"""Readers and writers for the contract tables.

CSV is the exchange format of the account-usage exports (statement texts hold
newlines, so reads are multi-line and not splittable: convert to Parquet once
and work from that); Parquet (zstd) is the working format; JSON carries
state and small documents. Every reader takes an explicit schema - nothing is
inferred for a contract table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC

#: Rows of a CSV file: a file with multi-line fields is read by one task.
CSV_ROWS = 200_000


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; any other failure (an unreachable store, a
    missing permission) is raised, never taken for an absent file."""
    try:
        spark.read.format("binaryFile").load(path)  # resolving the path checks it
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table, or None where nothing has been written yet."""
    return spark.read.parquet(path) if _exists(spark, path) else None


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with quoted multi-line fields; a missing file is an empty
    table of the same schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]")
            .csv(path))


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SC.QUERY_HISTORY_SCHEMA)


def read_csv_coerced(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Read every column as text, '' -> NULL, then give each column the
    narrowest of bigint / double / string that all its values parse as (one
    aggregate pass decides)."""
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    if limit:
        raw = raw.limit(limit)
    cleaned = raw.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])
    probe = cleaned.agg(*[x for c in cleaned.columns for x in (
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("bigint").isNull())
        .alias(f"{c}__notint"),
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull())
        .alias(f"{c}__notnum"))]).first()
    cols = []
    for c in cleaned.columns:
        if probe[f"{c}__notint"] == 0:
            cols.append(F.col(f"`{c}`").try_cast("bigint").alias(c))
        elif probe[f"{c}__notnum"] == 0:
            cols.append(F.col(f"`{c}`").try_cast("double").alias(c))
        else:
            cols.append(F.col(f"`{c}`").alias(c))
    return cleaned.select(*cols)


# ---- fixed values: what a cell is read as (white space around a number counts) ----
INT_CELL = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_CELL = (r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
              r"|nan|inf|infinity)\s*$")
# -----------------------------------------------------------------------------------


def typed_cell(cell: F.Column) -> F.Column:
    """One text cell as VARIANT - '' is NULL, then an integer (bigint, or
    decimal(38,0) beyond it), a double, or the text itself. Integers beyond 38
    digits become doubles."""
    plain = F.regexp_replace(F.trim(cell), "_", "")
    whole, number = cell.rlike(INT_CELL), cell.rlike(FLOAT_CELL)
    integer = F.coalesce(plain.try_cast("bigint").cast("variant"), plain.try_cast("decimal(38,0)").cast("variant"),
                         plain.try_cast("double").cast("variant"))
    return (F.when(cell == "", F.lit(None).cast("variant")).when(whole, integer)
            .when(number, plain.try_cast("double").cast("variant")).otherwise(cell.cast("variant")))


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of a header CSV typed by itself (VARIANT columns), so one
    column may hold integers, floats and text. No pass decides a column's type."""
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    return raw.select(*[typed_cell(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_batch(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """S3: one queue file (query_id, template_id, template_label,
    warehouse_size, query_text); optionally its first ``limit`` rows."""
    df = read_csv(spark, path, SC.QUEUE_SCHEMA)
    return df.limit(limit) if limit else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str,
              default: DataFrame | None = None, multi_line: bool = False) -> DataFrame:
    """JSON with a schema - one document per line (what ``write_json``
    writes) or, with ``multi_line``, one pretty-printed document per file; a
    missing path gives ``default`` (or an empty table)."""
    if not _exists(spark, path):
        return default if default is not None else spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Contract column order (extra columns ignored), NULL as empty field,
    quotes doubled, one header a file, ``CSV_ROWS`` rows a file at most."""
    out = df.select(*columns) if columns else df
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", "")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").option("maxRecordsPerFile", CSV_ROWS)
     .csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Zstd Parquet (optionally partitioned)."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def catalogue_stats(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Per table ROW_COUNT, BYTES (size of its distinct files) and
    split units (distinct (file, block start) pairs), from file metadata."""
    parts = []
    for name, path in tables.items():
        df = spark.read.parquet(path)
        # one grouped scan: rows and splits by file, whatever the size of a split
        by_file = (df.select("_metadata.file_path", "_metadata.file_size",
                             "_metadata.file_block_start").groupBy("file_path", "file_size")
                   .agg(F.count(F.lit(1)).alias("rows"),
                        F.countDistinct("file_block_start").alias("splits")))
        parts.append(by_file.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("ROW_COUNT"),
            F.sum("file_size").cast("bigint").alias("BYTES"),
            F.coalesce(F.sum("splits"), F.lit(0)).alias("SPLIT_UNITS")).select(
            F.lit(name.upper()).alias("TABLE_NAME"), "ROW_COUNT", "BYTES", "SPLIT_UNITS"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tables_layout(stats: DataFrame, created: str = "2026-08-21T00:00:00Z",
                  comment: F.Column | None = None) -> DataFrame:
    """TABLES rows (30 columns) from (TABLE_NAME, ROW_COUNT, BYTES)."""
    ts = F.to_timestamp(F.lit(created))
    filled = stats.select(
        F.lit(SC.DATABASE_NAME).alias("TABLE_CATALOG"), F.lit(SC.SCHEMA_NAME).alias("TABLE_SCHEMA"),
        F.upper("TABLE_NAME").alias("TABLE_NAME"), F.lit(SC.TABLE_OWNER).alias("TABLE_OWNER"),
        F.lit("BASE TABLE").alias("TABLE_TYPE"), F.lit("NO").alias("IS_TRANSIENT"),
        "ROW_COUNT", "BYTES", F.lit(1).alias("RETENTION_TIME"),
        F.lit("YES").alias("IS_INSERTABLE_INTO"), F.lit("YES").alias("IS_TYPED"),
        ts.alias("CREATED"), ts.alias("LAST_ALTERED"), ts.alias("LAST_DDL"),
        F.lit(SC.USER_NAME).alias("LAST_DDL_BY"), F.lit("NO").alias("AUTO_CLUSTERING_ON"),
        (comment if comment is not None else F.lit(None).cast("string")).alias("COMMENT"),
        F.lit("ROLE").alias("OWNER_ROLE_TYPE"), F.lit("NO").alias("IS_TEMPORARY"),
        F.lit("NO").alias("IS_ICEBERG"), F.lit("NO").alias("IS_DYNAMIC"),
        F.lit("NO").alias("IS_IMMUTABLE"), F.lit("NO").alias("IS_HYBRID"))
    return SC.conform(filled, SC.TABLES_SCHEMA)


def pending_files(spark: SparkSession, folder: str, loaded: DataFrame,
                  pattern: str = "*.csv") -> DataFrame:
    """Files of ``folder`` not yet in ``loaded`` (a ``name`` column), in
    name order. Only paths are listed (file contents are not read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
             .select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path"))
    return files.join(loaded.select("name"), "name", "left_anti").orderBy("name")


def cut_in_batches(df: DataFrame, ordinal: str, size: int = 40) -> DataFrame:
    """Batch number = floor((row_number - 1) / size) + 1 in ``ordinal``
    order (rank from block offsets, no single-partition window)."""
    from ..operators.ordinal import block_position
    ranked = block_position(df, [], ordinal, "__rn", base=1)
    return ranked.withColumn("batch", (F.floor((F.col("__rn") - 1) / size) + 1).cast("int")) \
        .drop("__rn")


def publish(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Overwrite every published table (idempotent), then report the
    row count of each as written (read back from the files)."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}")
        counts.append(spark.read.parquet(f"{folder}/{name}")
                      .agg(F.count(F.lit(1)).alias("row_count"))
                      .select(F.lit(name).alias("table_name"), "row_count"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def bounded_sample(df: DataFrame, order: list, rows: int = 120) -> DataFrame:
    """The first ``rows`` rows in a total order (a top-k, not a sample)."""
    return df.orderBy(*order).limit(rows)


def upsert_batches(df: DataFrame, path: str, partition: str = "QUERY_TAG") -> None:
    """Replace the partitions present in ``df``, keep the others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(partition).parquet(path))
