import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def notes(spark):
    """Notes from (path, content) pairs, or contents alone."""

    def make(*contents):
        rows = [(f"n{i}.md", f"n{i}.md", c, None, None) if isinstance(c, str) or c is None else (c[0], c[0].rsplit("/", 1)[-1], c[1], None, None) for i, c in enumerate(contents)]
        return spark.createDataFrame(rows, "path string, file_name string, content string, size long, mtime timestamp")

    return make
