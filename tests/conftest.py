import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def engine(spark):
    """A small log with sparse fields, null values, ties in time and rows out of order."""
    from emberlog.engine import Engine

    rows = [
        (1, "2024-01-01T00:00:10Z", "api", "INFO", 200, 12.0, "login user=ann", ["a", "b"]),
        (2, "2024-01-01T00:00:05Z", "api", "ERROR", 500, 90.0, "timeout after 30s user=bob", []),
        (3, "2024-01-01T00:07:00Z", "web", "INFO", 200, None, "GET /x", ["c"]),
        (4, "2024-01-01T00:40:00Z", "web", None, None, 7.0, "connection reset by 10.0.0.1", None),
        (5, "2024-01-01T00:40:00Z", "api", "WARN", 404, 33.0, None, ["a"]),
        (6, "2024-01-01T02:00:00Z", None, "INFO", 200, 1.0, "Timeout!", ["d", "e"]),
    ]
    df = spark.createDataFrame(rows, "id long, t string, service string, level string, status long, ms double, _raw string, tags array<string>")
    df = df.selectExpr("id", "cast(t as timestamp) as _time", "service", "level", "status", "ms", "_raw", "tags")
    return Engine(spark).source("main", df, order=["id"])
