from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("salesaudit-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Sales rows from dicts; what a dict leaves out is NULL."""
    from salesaudit.sources.schema import COLUMNS, SALES

    def build(*rows: dict):
        def cell(name, value):
            money = name in ("total_payment", "total_plan_amount") and value is not None
            return Decimal(str(value)) if money else value

        tuples = [tuple(cell(name, row.get(name)) for name in COLUMNS) for row in rows]
        return spark.createDataFrame(tuples, SALES)

    return build


@pytest.fixture(scope="session")
def plan_text():
    """The physical plan of a frame before it has run."""
    return lambda frame: frame._jdf.queryExecution().executedPlan().toString()
