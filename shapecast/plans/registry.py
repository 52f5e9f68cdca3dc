"""The registered queries: name -> (DataFrame builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole testdata tables (or data Spark derives from them). The SQL twin, where
there is one, must give the same rows and column names in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return wrap


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the plan modules fills REGISTRY.
    from . import (q_boosted, q_calibrate, q_features, q_io, q_model, q_report,  # noqa: F401
                   q_shape, q_star, q_summary)
    return REGISTRY
