import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shapecast.session import get_spark
    s = get_spark("local[4]", 4)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


# Seven catalogue rows (name, rows, bytes).
CATALOGUE = [("FACT_EVENT_S", 2000000, 28573696), ("FACT_EVENT_M", 3000000, 42467328),
             ("FACT_EVENT_L", 5000000, 70778880), ("FACT_EVENT_X", 8000000, 112984064),
             ("DIM_CUSTOMER_WL", 50000, 524288), ("DIM_PRODUCT_WL", 5000, 262144),
             ("DIM_REGION_WL", 200, 262144)]


@pytest.fixture(scope="session")
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "TABLE_NAME string, ROW_COUNT bigint, BYTES bigint")
