"""A training corpus from ``documents``: five stages, each written and read again.

quality classifier -> near-duplicate join -> repeated substrings -> personal
data -> packed token sequences. Every stage works on all rows that its
predecessor kept; all but the last return the columns of ``documents``. Null
and odd rows behave as each operator's module says; an empty table passes
through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapecast.llm.common import table, written
from shapecast.llm.disclosure import sanitise
from shapecast.llm.fit_packing import pack
from shapecast.llm.kneser_ney import keep_good
from shapecast.llm.lsh_forest import drop_near_duplicates
from shapecast.llm.suffix_dedup import remove_repeats

#: Tokens of a packed sequence.
CAPACITY = 4096
#: The stages fit a model and order suffixes, which SQL cannot express.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(remove_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(sanitise(docs, context=None))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
