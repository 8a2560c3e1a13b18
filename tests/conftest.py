from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidecast-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


START = dt.date(2026, 1, 1)


def day(i: int, step: int = 1) -> str:
    return (START + dt.timedelta(days=i * step)).isoformat()


def put(folder: str, name: str, body: str | bytes) -> None:
    mode = "wb" if isinstance(body, bytes) else "w"
    kwargs = {} if isinstance(body, bytes) else {"encoding": "utf-8", "newline": ""}
    with open(os.path.join(folder, name), mode, **kwargs) as f:
        f.write(body)
