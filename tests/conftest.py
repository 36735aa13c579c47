import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inboxlake.sources.tables import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("inboxlake-tests")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table(name, row, row, ...)``: rows as dicts, missing columns NULL, in the declared schema."""

    def build(name, *rows):
        empty = spark.createDataFrame([], SCHEMAS[name])
        columns = empty.columns
        return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], empty.schema)

    return build


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
