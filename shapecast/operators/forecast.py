"""The queue scored before it runs.

Pre-run rows get the prior of everything measured, the shape of their text and,
where there is a model, a predicted runtime. Without a model the same columns
come back without a prediction; an empty queue gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape as S
from . import features as fe
from . import shape as shape_op

#: Columns of a forecast row; with a model predicted_ms and predicted_by follow.
COLUMNS = ["query_id", "template_id", "template_label", "warehouse_size", "n_tables", "n_joins", "table_rows", "has_group_by",
           "has_order_by", "has_window", "limit_rows", "predicate_literal", "seen_before", "query_text"]


def forecast(queue: DataFrame, index: DataFrame, catalogue: DataFrame, model=None, fit: tuple[int, int] | None = None,
             version: str | None = None) -> DataFrame:
    """``queue``: query_id, template_id, template_label, warehouse_size, query_text.
    ``index``: past means by parameterised hash. ``model``: has log_ms(b, fold, x);
    ``fit`` is its (b, fold), ``version`` the name that is put beside a prediction."""
    pre = queue.select(F.col("query_id").alias("QUERY_ID"), F.col("query_text").alias("QUERY_TEXT"),
                       shape_op.check_warehouse().alias("WAREHOUSE_SIZE"),
                       S.parameterized_hash(F.col("query_text")).alias("QUERY_PARAMETERIZED_HASH"))
    feats = fe.featurise(fe.attach_prior(pre, index), catalogue, passthrough=("table_rows", "limit_rows"))
    whole = ["n_tables", "n_joins", "has_group_by", "has_order_by", "has_window"]
    shaped = feats.select(
        F.col("QUERY_ID").alias("query_id"), *[F.col(c).cast("int").alias(c) for c in whole], F.col("table_rows").cast("long").alias("table_rows"),
        F.col("limit_rows").cast("long").alias("limit_rows"), "predicate_literal", F.col("has_prior").cast("int").alias("seen_before"),
        F.array(*[F.col(f).cast("double") for f in fe.FEATURES]).alias("x"))
    source = queue.select("query_id", "template_id", "template_label", "warehouse_size", "query_text")
    if model is None:
        return shaped.drop("x").join(source, "query_id").select(*COLUMNS)
    b, fold = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(fe.FEATURES))
            names = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.exp(model.log_ms(b, fold, x)))], [*names, "p"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shaped.schema.fields if f.name != "x")
    scored = shaped.mapInArrow(run, f"{kinds}, p double")
    return scored.join(source, "query_id").select(*COLUMNS, F.round("p", 2).alias("predicted_ms"), F.lit(version).alias("predicted_by"))
