import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("8")
    yield spark
    spark.stop()


@pytest.fixture
def numeric(spark):
    rows = [
        (25.0, 50_000, "ann"),
        (30.0, 60_000, "ben"),
        (None, 55_000, "cid"),
        (35.0, 70_000, None),
        (40.0, 500_000, "eve"),
        (float("nan"), 62_000, "fay"),
        (28.0, 58_000, "gus"),
    ]
    return spark.createDataFrame(rows, "age double, salary bigint, name string")


@pytest.fixture
def mixed(spark):
    rows = [
        (20 + i, 1000 * (i + 1), ["x", "y"][i % 2], "on" if i < 4 else "off", f"2024-01-0{i + 1} 00:00:00")
        for i in range(7)
    ]
    df = spark.createDataFrame(rows, "age bigint, salary bigint, department string, status string, date string")
    return df.withColumn("date", df.date.cast("timestamp_ntz"))
