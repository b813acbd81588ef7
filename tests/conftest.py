import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from wardstone.session import tune

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/wardstone-test-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def base():
    return "/root/testdata/sf0.001"


@pytest.fixture
def ts():
    """A zone-less timestamp so many hours (and microseconds) after a fixed start."""
    from datetime import datetime, timedelta

    return lambda hours=0.0, micros=0: datetime(2130, 1, 1) + timedelta(hours=hours, microseconds=micros)
