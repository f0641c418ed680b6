from __future__ import annotations

import os

import pytest

from menuspark.session import build_session
from menuspark.sources.driver_tables import Domain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("driver tables are not here")
    return SMALL


@pytest.fixture(scope="session")
def domain(spark, small):
    return Domain(spark, small)
