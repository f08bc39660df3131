from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import salesaudit as audit
from salesaudit.sources.folders import new_folder, shared_folder
from salesaudit.sources.schema import COLUMNS
from salesaudit.sources.tables import CSV, OPEN_FILES, read_sales_csv

WHEN = datetime(2024, 5, 31, 23, 59, 59, 999000)


@pytest.fixture()
def rows(make):
    return make(
        {
            "sales_item_id": "a",
            "transaction_date": WHEN,
            "last_touched_at": datetime(2024, 6, 1, 12, 0, 0, 5000),
            "sales_details": 'said "yes", then left | gone',
            "price_level": "",
            "price_type": "  padded ",
            "total_payment": "12.30",
            "is_hospitality": True,
        },
        {"sales_item_id": "b", "transaction_date": datetime(2025, 1, 1), "total_payment": "-0.01"},
        {"sales_item_id": "c"},
    )


def test_csv_ingest_keeps_every_value(spark, rows):
    raw, table = new_folder(spark, "raw"), new_folder(spark, "table")
    rows.write.options(**CSV).csv(raw)
    loaded = audit.ingest_csv(spark, raw, table)
    assert tuple(loaded.columns) == COLUMNS
    assert loaded.schema["total_payment"].dataType == T.DecimalType(18, 2)
    assert sorted(map(str, loaded.collect())) == sorted(map(str, rows.collect()))
    years = spark.read.parquet(table).select("sale_year").distinct()
    assert {row[0] for row in years.collect()} == {2024, 2025, None}


def test_csv_ingest_shuffles_no_rows(spark, rows):
    """Each job of the ingest is one stage; the session's settings stay."""
    raw, table = new_folder(spark, "raw"), new_folder(spark, "table")
    rows.repartition(3).write.options(**CSV, compression="gzip").csv(raw)
    before, tracker = spark.conf.get(OPEN_FILES), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ingest", "")
    try:
        loaded = audit.ingest_csv(spark, raw, table)
        stages = [len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup("ingest")]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert stages and set(stages) == {1}
    assert spark.conf.get(OPEN_FILES) == before
    assert sorted(map(str, loaded.collect())) == sorted(map(str, rows.collect()))


def test_malformed_csv_is_an_error(spark, tmp_path):
    text = ",".join(COLUMNS) + "\n" + ",".join("x" for _ in COLUMNS) + "\n"
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        read_sales_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_quoted_line_breaks_need_multi_line(spark, make):
    raw = new_folder(spark, "raw")
    make({"sales_item_id": "a", "sales_details": "one\ntwo"}).write.options(**CSV).csv(raw)
    assert read_sales_csv(spark, raw, multi_line=True).first()["sales_details"] == "one\ntwo"


def test_load_by_path_table_and_absent_source(spark, rows):
    path = new_folder(spark, "sales")
    rows.write.parquet(path)
    assert audit.load_sales(spark, path).count() == 3
    rows.createOrReplaceTempView("sales_history")
    assert audit.load_sales(spark, "sales_history").count() == 3
    with pytest.raises(FileNotFoundError):
        audit.load_sales(spark, "no_such_table")
    with pytest.raises(FileNotFoundError):
        audit.load_sales(spark, path + "-absent")


def test_results_round_trip_and_absent_result_is_empty(spark, rows):
    folder = new_folder(spark, "results")
    report = audit.price_level_performance(rows)
    back = audit.read_result(spark, audit.save_result(report, folder, "levels"), report.schema)
    assert back.collect() == report.collect()
    absent = audit.read_result(spark, f"{folder}/absent", report.schema)
    assert absent.schema == report.schema and absent.count() == 0


def test_shared_folder_is_what_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or shared_folder(spark))
    assert new_folder(spark, "x") != new_folder(spark, "x")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_inventory_forms(make):
    inventory = audit.column_inventory(make())
    assert inventory.count() == 27
    lines = {row["column_name"]: row for row in inventory.collect()}
    assert [row["ordinal_position"] for row in inventory.collect()] == list(range(1, 28))
    assert lines["transaction_date"]["data_type"] == "timestamp without time zone"
    assert lines["last_touched_at"]["data_type"] == "timestamp with time zone"
    assert (lines["total_payment"]["numeric_precision"], lines["total_payment"]["numeric_scale"]) == (18, 2)
    assert lines["seat"]["data_type"] == "text" and lines["seat"]["character_maximum_length"] is None
    assert {row["is_nullable"] for row in inventory.collect()} == {"YES"}
    assert audit.column_types(make()).columns == ["ordinal_position", "column_name", "data_type", "is_nullable"]
    assert audit.column_schema(make()).columns == ["column_name", "data_type", "is_nullable"]


def test_sample_is_repeatable_and_profiled(make):
    sales = make(*({"sales_item_id": str(i % 7), "seat": None if i % 2 else "1"} for i in range(40)))
    first = audit.raw_sample(sales, 10)
    assert first.collect() == audit.raw_sample(sales.repartition(5), 10).collect()
    assert [row["sales_item_id"] for row in first.collect()] == ["0"] * 6 + ["1"] * 4
    profile = {row["column_name"]: row for row in audit.sample_profile(sales, 10).collect()}
    assert profile["sales_item_id"]["non_null_count"] == 10
    assert profile["seat"]["non_null_count"] == first.where(F.col("seat").isNotNull()).count()
    assert profile["total_payment"]["data_type"] == "numeric"


def test_whole_audit_is_written(spark, rows):
    from salesaudit.plans.audit import run_audit

    folder = new_folder(spark, "audit")
    paths = run_audit(rows, folder, as_of="2024-12-31 00:00:00", expected_rows=3)
    assert len(paths) == 27
    kpis = audit.read_result(spark, paths["27_executive_kpis"], "metric string, value double").collect()
    assert kpis[0]["value"] == 3.0 and kpis[-1]["value"] == len(
        audit.read_result(
            spark,
            paths["26_business_issue_register"],
            "category string, severity string, issue string, evidence string, business_impact string, "
            "recommended_action string",
        ).collect()
    )
    direct = audit.business_issues(rows, 3, "2024-12-31 00:00:00").collect()
    assert kpis[-1]["value"] == len(direct)
    overview = audit.dataset_overview(rows)
    saved = audit.read_result(spark, paths["01_dataset_overview"], overview.schema)
    assert saved.collect() == overview.collect()
