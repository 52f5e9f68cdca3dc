import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from shapecast.session import get_spark
    yield get_spark("local[4]", 4)


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """Writes tables as Parquet, as the driver's folders have them."""
    def write(**tables):
        top = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{top}/{name}.parquet")
        return str(top)
    return write


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang]) rows, with an extra column of a clashing name."""
    from pyspark.sql import functions as F

    def make(rows, extra="hash"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC).withColumn(extra, F.lit(1)).repartition(3)
    return make
