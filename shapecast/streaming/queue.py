"""Incremental intake of measured batches (T1-T3) with Structured Streaming.

Each file in the intake folder holds rows of a measured batch (statement rows
with their runtime and position); a batch may come in several files. A
file-source stream with
``maxFilesPerTrigger=1`` and ``trigger(availableNow=True)`` processes exactly
the files not yet seen, one micro-batch per file, in arrival order; the
stream checkpoint is the record of loaded files (S14/T1).

``run_next`` takes files in name order instead, one a run, from a table of the
files taken so far (T1); both end in ``process_batch``:
  0. the file's rows are joined to those of the same batch that came in earlier
     files (a row that comes again replaces the stored one), so a batch is
     always calibrated as a whole;
  1. drift readings of the batch (every tenth position and the end) and the
     baseline: the first batch's first reading (C3);
  2. calibrated target (C1/C2);
  3. prior from strictly earlier batches of the same parameterised hash, read
     from the state table of per-(hash, batch) sums and counts (T3/A6);
  4. the batch's rows replace its partition of the history table and its
     sums replace its partition of the state table (dynamic partition
     overwrite: a re-run of the same batch changes nothing, T2);
  5. batches already taken in that come later by their tag are derived again
     from their stored rows, so a late file repairs their targets and priors.

A state table that is not there yet is empty; any other failure to read one
is raised.

All state lives in folders under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shape as S
from ..operators import calibrate as cal
from ..operators import features as fe
from ..session import materialize
from ..sources.history_io import read_parquet_or_none

INTAKE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("query_id", T.StringType()),
    T.StructField("query_tag", T.StringType()), T.StructField("template_id", T.StringType()),
    T.StructField("warehouse_size", T.StringType()), T.StructField("query_text", T.StringType()),
    T.StructField("execution_ms", T.DoubleType()), T.StructField("pos", T.LongType())])


def write_intake(log: DataFrame, folder: str, files: int = 1) -> None:
    """JSON-lines files per batch tag under ``query_tag=<tag>/``, ``files`` for
    each, written in tag order so that file age follows the batch order the stream
    relies on (the shape a producer writes; used by tests and registered queries)."""
    rows = log.select(*[f.name for f in INTAKE_SCHEMA.fields])
    tags = sorted(r[0] for r in rows.select("query_tag").distinct().collect())  # a few batches
    for tag in tags:
        (rows.filter(F.col("query_tag") == tag).drop("query_tag").repartition(files)
         .write.mode("overwrite").json(f"{folder}/query_tag={tag}"))


def readings(batch: DataFrame) -> DataFrame:
    """Drift readings of one batch (same law as ``plans.qlog.qcal``)."""
    from ..plans.qlog import qcal
    return qcal(batch.sparkSession, "", batch)


def one_row_each(batch: DataFrame) -> DataFrame:
    """A statement that a file holds twice keeps its greatest row (by seq, then the other columns)."""
    columns = [f.name for f in INTAKE_SCHEMA.fields]
    rest = [c for c in columns if c not in ("query_tag", "query_id")]
    last = batch.groupBy("query_tag", "query_id").agg(F.max(F.struct(*rest)).alias("r"))
    return last.select(*[F.col(c) if c not in rest else F.col("r")[c].alias(c) for c in columns])


def process_batch(batch: DataFrame, state: str, history: str, baseline: str,
                  catalogue: DataFrame | None = None, versions: str | None = None) -> None:
    """Takes rows of one or more batches into history and state, in tag order. Batches
    that were taken in before but come later by their tag are derived anew, as
    their priors (and, behind a new first batch, their drift factors) change: the
    tables do not depend on the order in which files arrive."""
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    columns = [f.name for f in INTAKE_SCHEMA.fields]
    batch = one_row_each(batch.select(*columns))
    stored = read_parquet_or_none(spark, history)
    if stored is not None:
        known = stored.select(*columns).join(batch.select("query_tag").distinct(), "query_tag", "left_semi")
        batch = batch.unionByName(known.join(batch.select("query_tag", "query_id"),
                                             ["query_tag", "query_id"], "left_anti"))
    batch = materialize(batch)      # the partitions it was read from are replaced below
    tags = lambda df: sorted(r[0] for r in df.select("query_tag").distinct().collect())  # noqa: E731  a few batches
    new = tags(batch)
    before = tags(stored) if stored is not None else []
    late = [t for t in before if t > new[0] and t not in new]
    first = min(new + before)
    for tag in sorted(new + late):
        rows = batch if tag in new else spark.read.parquet(history).select(*columns)
        rows = rows.filter(F.col("query_tag") == tag)
        derive(rows if tag in new else materialize(rows), tag, tag == first, state, history, baseline)
    if catalogue is not None and versions:
        append_versions(spark, history, catalogue, versions, latest_only=not late)


def derive(batch: DataFrame, tag: str, first: bool, state: str, history: str, baseline: str) -> None:
    """Target, prior and sums of one whole batch; replaces its partitions."""
    spark = batch.sparkSession
    checkpoints = readings(batch)
    if first:                       # the first batch: its first reading is the baseline
        cal.baseline_reading(checkpoints).write.mode("overwrite").parquet(baseline)
    scored = cal.calibrate(batch, checkpoints, spark.read.parquet(baseline))
    scored = scored.withColumn("QUERY_PARAMETERIZED_HASH", S.parameterized_hash(F.col("query_text")))
    past = read_parquet_or_none(spark, state)
    if past is None:
        past = spark.createDataFrame([], "QUERY_PARAMETERIZED_HASH string, s bigint, n bigint, query_tag string")
    prior = (past.filter(F.col("query_tag") < tag).groupBy("QUERY_PARAMETERIZED_HASH")
             .agg(F.sum("s").alias("__s"), F.sum("n").alias("__n"))
             .withColumn("__p", fe.mean_3dp("__s", "__n")))
    seen = F.coalesce("__n", F.lit(0)) > 0
    out = materialize(scored.join(prior, scored["QUERY_PARAMETERIZED_HASH"].eqNullSafe(
        prior["QUERY_PARAMETERIZED_HASH"]), "left").drop(prior["QUERY_PARAMETERIZED_HASH"])
        .select("query_id", "query_tag", "seq", "pos", "template_id",
                "QUERY_PARAMETERIZED_HASH", "query_text", "warehouse_size", "execution_ms",
                F.col("calibrated_execution_ms").alias("TARGET_MS"), "machine_factor",
                F.when(seen, F.lit(1)).otherwise(F.lit(0)).alias("HAS_PRIOR"),
                F.when(seen, F.col("__p")).alias("PRIOR_EXECUTION_MS")))
    sums = (out.groupBy("QUERY_PARAMETERIZED_HASH", "query_tag")
            .agg(F.sum(fe.thousandths("TARGET_MS")).alias("s"), F.count(F.lit(1)).alias("n")))
    for df, path in ((out, history), (sums, state)):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("query_tag").parquet(path))


def folders(root: str) -> dict:
    return {"checkpoint": f"{root}/stream_checkpoint", "state": f"{root}/prior_state",
            "history": f"{root}/history", "baseline": f"{root}/baseline",
            "versions": f"{root}/versions", "loaded": f"{root}/loaded_files"}


def pending(spark: SparkSession, intake: str, root: str) -> DataFrame:
    """Intake files (path below the folder, as ``name``) that no run has taken yet.
    Only names are listed, no file is opened."""
    top = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(intake)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+/[^/]+|[^/]+)$", 1), "%3D", "=")
    files = top.select(name.alias("name"), "path")
    loaded = read_parquet_or_none(spark, folders(root)["loaded"])
    return files if loaded is None else files.join(loaded.select("name"), "name", "left_anti")


def run_next(spark: SparkSession, intake: str, root: str, catalogue: DataFrame | None = None) -> str | None:
    """Takes in exactly one unseen file, the first in name order, whatever the
    files' ages; its name, or None if there is none. A file counts as taken only
    after its batch is written: a run that broke takes the same file again, with
    the same result."""
    paths = folders(root)
    chosen = pending(spark, intake, root).orderBy("name").limit(1).first()
    if chosen is None:
        return None
    rows = spark.read.schema(_intake_schema()).option("basePath", intake).json(chosen["path"])
    process_batch(rows, paths["state"], paths["history"], paths["baseline"], catalogue, paths["versions"])
    spark.createDataFrame([(chosen["name"],)], "name string").coalesce(1).write.mode("append").parquet(paths["loaded"])
    return chosen["name"]


def run_in_name_order(spark: SparkSession, intake: str, root: str, catalogue: DataFrame | None = None) -> list[str]:
    """Runs until no file is left: the names taken in, in order."""
    taken = []
    while (name := run_next(spark, intake, root, catalogue)) is not None:
        taken.append(name)
    return taken


def run_intake(spark: SparkSession, intake: str, root: str,
               catalogue: DataFrame | None = None) -> dict:
    """Process every intake file not processed before; returns the folders.
    With a ``catalogue`` every batch also trains and appends the newest model
    version (``versions`` folder)."""
    paths = folders(root)
    stream = (spark.readStream.schema(_intake_schema())
              .option("maxFilesPerTrigger", 1).json(intake))
    query = (stream.writeStream
             .foreachBatch(lambda df, _epoch: process_batch(
                 df, paths["state"], paths["history"], paths["baseline"],
                 catalogue, paths["versions"]))
             .option("checkpointLocation", paths["checkpoint"])
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return paths


def _intake_schema() -> T.StructType:
    # The tag is the partition folder name of the intake files.
    return T.StructType([f for f in INTAKE_SCHEMA.fields if f.name != "query_tag"]
                        + [T.StructField("query_tag", T.StringType())])


def append_versions(spark: SparkSession, history: str, catalogue: DataFrame, versions: str,
                    latest_only: bool = True) -> None:
    """Train on every batch so far and append the newest version's metrics
    (one row per run, partition ``model_sequence``: a re-run replaces it).
    Each row is scored once, so a run is O(rows); earlier versions are state.
    Behind a late file (``latest_only`` False) every version is written again."""
    from ..operators import features as fe
    from ..operators import metrics as M
    from ..operators import versions as V
    from ..plans import evaluate as E
    rows = spark.read.parquet(history).select(
        F.col("query_id").alias("QUERY_ID"), F.col("query_tag").alias("QUERY_TAG"),
        F.col("query_text").alias("QUERY_TEXT"), F.col("warehouse_size").alias("WAREHOUSE_SIZE"),
        "HAS_PRIOR", "PRIOR_EXECUTION_MS", "TARGET_MS", F.col("execution_ms").alias("EXECUTION_TIME"),
        "seq", "pos")
    feats = fe.featurise(rows, catalogue, keys=("QUERY_ID", "QUERY_TAG"))
    extra = rows.select("QUERY_ID", "TARGET_MS", "EXECUTION_TIME", "seq", "pos")
    numbered = V.numbered(feats.join(extra, "QUERY_ID"))
    st = materialize(V.state(numbered))
    if st.agg(F.sum("n")).first()[0] < M.MIN_ROWS_TO_TRAIN:       # M7: no version yet
        return
    newest = E.version_metrics(numbered, st, V.models(st), latest_only=latest_only)
    (newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model_sequence").parquet(versions))
