import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shelfwatch.session import configured

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{folder}/checkpoints").config("spark.sql.warehouse.dir", f"{folder}/warehouse")
    session = configured(builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
