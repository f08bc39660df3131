"""Inputs that do not fit are errors, not silent damage."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import salesaudit as audit
from salesaudit.sources import folders
from salesaudit.sources.folders import new_folder
from salesaudit.sources.schema import COLUMNS, SALES
from salesaudit.sources.tables import CSV, read_sales_csv


def test_header_in_another_order_is_refused(spark, make):
    raw = new_folder(spark, "raw")
    swapped = list(COLUMNS)
    a, b = swapped.index("price_level"), swapped.index("price_type")
    swapped[a], swapped[b] = swapped[b], swapped[a]
    make({"price_level": "level", "price_type": "type"}).select(*swapped).write.options(**CSV).csv(raw)
    with pytest.raises(Exception, match="header"):
        read_sales_csv(spark, raw).collect()


@pytest.mark.parametrize(
    ("columns", "match"), [("b, a", "header"), ("a, 'xx' AS b", "MALFORMED|malformed|FAILED_READ")]
)
def test_damaged_result_is_an_error(spark, columns, match):
    path = new_folder(spark, "result")
    spark.sql(f"SELECT {columns} FROM VALUES ('x', 1) AS t(a, b)").write.options(**CSV).csv(path)
    with pytest.raises(Exception, match=match):
        audit.read_result(spark, path, "a string, b long").collect()


def test_declared_types_and_own_columns(spark, make):
    path = new_folder(spark, "sales")
    sales = make({"total_payment": "1.10"}, {"total_payment": None})
    sales.withColumn("total_payment", F.col("total_payment").cast("double")).withColumn("sale_year", F.lit(7)).write.parquet(path)
    loaded = audit.load_sales(spark, path)
    assert loaded.schema["total_payment"].dataType == SALES["total_payment"].dataType
    assert sorted(str(row["total_payment"]) for row in loaded.collect()) == ["1.10", "None"]
    assert "sale_year" in loaded.columns


def test_lossy_money_is_an_error(spark, make):
    path = new_folder(spark, "sales")
    make({}).withColumn("total_payment", F.lit(1.005)).write.parquet(path)
    with pytest.raises(Exception, match="total_payment"):
        audit.load_sales(spark, path).select("total_payment").collect()


def test_other_errors_keep_their_name(spark):
    with pytest.raises(Exception) as caught:
        audit.load_sales(spark, "/nowhere", format="no-such-format")
    assert not isinstance(caught.value, FileNotFoundError)


def test_a_cluster_without_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folders.shared_folder(session)


@pytest.mark.parametrize(
    ("operator", "column"),
    [
        (audit.account_activity, "transaction_date"),
        (audit.duplicate_primary_tickets, "primary_ticket_id"),
        (audit.duplicate_transactions, "transaction_date"),
        (audit.potential_data_grain, "sale_type"),
    ],
)
def test_lists_without_their_column_are_empty(make, operator, column):
    sales = make({"total_payment": 1, "transaction_id": "t"})
    without = operator(sales.drop(column))
    assert without.schema == operator(sales).schema and without.collect() == []
