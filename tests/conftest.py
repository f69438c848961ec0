"""One Spark session for all tests."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

CPUS = os.environ.get("TEST_CPUS", "8")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
