"""What the physical plans look like, with broadcast joins switched off."""

from __future__ import annotations

import re

import pytest
from places import DATA

import salesaudit as audit
from salesaudit.catalogue.queries import QUERIES
from salesaudit.sources.folders import new_folder
from salesaudit.sources.schema import IDENTIFIERS
from salesaudit.sources.star import star_sales

FOLDER = f"{DATA}/sf0.001"
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    for name in THRESHOLDS:
        spark.conf.set(name, "-1")
    yield
    for name in THRESHOLDS:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def sales(spark):
    """The wide table on disk, as a user has it."""
    path = new_folder(spark, "wide")
    star_sales(spark, FOLDER).write.parquet(path)
    return audit.load_sales(spark, path)


def executed(frame) -> str:
    """The plan that ran, without the plans AQE replaced."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    kept, skipping = [], None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-|"))
        if skipping is not None and depth >= skipping:
            continue
        skipping = depth if "== Initial Plan ==" in line else None
        if skipping is None:
            kept.append(line)
    return "\n".join(kept)


def scans(plan: str) -> int:
    return len(re.findall("FileScan", plan))


@pytest.mark.parametrize(
    "operator, passes",
    [
        (audit.dataset_overview, 1),
        (audit.missing_by_column, 1),
        (audit.missing_wide, 1),
        (audit.identifier_uniqueness, 1),
        (audit.identifier_uniqueness_wide, 1),
        (audit.duplicate_group_summary, 1),
        (audit.potential_data_grain, 1),
        (audit.product_type_performance, 1),
        (audit.product_type_basic, 1),
        (audit.application_channel_performance, 1),
        (audit.sales_rep_performance, 1),
        (audit.top_groups, 1),
        (audit.monthly_trend_flagged, 1),
        (audit.payment_percentiles_long, 1),
        (audit.payment_statistics, 1),
        (audit.payment_analysis, 1),
        (audit.dataset_coverage, 1),
        (audit.raw_sample, 1),
        (audit.high_value_transactions, 2),
        (audit.account_activity, 1),
        (audit.duplicate_transactions, 1),
        (audit.duplicate_sales_items, 1),
        (audit.revenue_concentration_full, 1),
        (audit.revenue_concentration, 1),
        (audit.audit_flags, 1),
        (audit.business_issues, 2),
        (audit.executive_kpis, 3),
        (audit.chart_series, 4),
    ],
)
def test_table_is_read_no_more_than_needed(sales, operator, passes):
    assert scans(executed(operator(sales))) == passes


def test_only_needed_columns_are_read(sales):
    plan = executed(audit.product_type_performance(sales))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {
        "product_type:string,total_payment:decimal(18,2)"
    }
    plan = executed(audit.payment_sign_counts(sales))
    assert "ReadSchema: struct<total_payment:decimal(18,2)>" in plan


def test_filters_reach_the_scan(sales):
    assert "IsNotNull(transaction_id)" in executed(audit.duplicate_transactions(sales))
    assert "IsNotNull(internal_account_id)" in executed(audit.account_activity(sales))
    assert "IsNotNull(total_payment)" in executed(audit.high_value_transactions(sales))


def test_top_lists_do_not_sort_the_table(sales):
    for operator in (
        audit.high_value_transactions,
        audit.account_activity,
        audit.duplicate_transactions,
        audit.product_description_performance,
    ):
        plan = executed(operator(sales))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_sample_sorts_nothing(sales):
    for operator in (audit.raw_sample, audit.sample_profile):
        plan = executed(operator(sales))
        assert "TakeOrderedAndProject" in plan and "Window" not in plan
        assert not re.search(r"Sort \[sales_item_id", plan)


def test_summary_joins_the_star_tables_once(spark):
    plan = executed(QUERIES["audit_summary"](spark, FOLDER))
    assert scans(plan) >= 2 and "l_orderkey" not in plan


def test_concentration_windows(sales):
    """The running sum sees the top rows only, or one part of a band."""
    plan = executed(audit.revenue_concentration(sales))
    window = plan[plan.index(" Window ") :]
    assert "TakeOrderedAndProject" in window
    full = audit.revenue_concentration_full(sales)
    plan = executed(full)
    assert "ExistingRDD" not in plan and re.search(r"Window \[row_number\(\)[^\n]*\[narrow#\d+L, paid#\d+, part#", plan)
    # the one window without a partition sums the wide bands
    windows = [line for line in plan.split("\n") if " Window [" in line]
    alone = [line for line in windows if not re.search(r"\], \[[^\[\]]*\], \[[^\[\]]*\]$", line)]
    assert len(windows) == 4 and len(alone) == 1 and re.search(r", \[wide#\d+L DESC", alone[0])
    # the global order is the last step; nothing is summed over sampled ranges
    assert plan.count("rangepartitioning") == 1 and plan.index("rangepartitioning") < plan.index("row_number")


def test_declaring_the_full_concentration_runs_nothing(spark, sales):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("declare", "")
    try:
        audit.revenue_concentration_full(sales)
        assert list(tracker.getJobIdsForGroup("declare")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_distinct_counts_share_one_shuffle_without_expand(sales):
    plan = executed(audit.dataset_coverage(sales))
    assert "Expand" not in plan and len(re.findall(r"Exchange hashpartitioning\(position#\d+, value#", plan)) == 1


def _rows_in_last_task(frame) -> int:
    """Rows that the single task of the last shuffle reads."""
    frame.collect()
    node = frame._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("TakeOrdered"):
        wrapped = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan"}
        found = next((name for start, name in wrapped.items() if node.nodeName().startswith(start)), None)
        node = getattr(node, found)() if found else node.children().apply(0)
    return node.metrics().apply("recordsRead").value()


@pytest.mark.parametrize("parts", [64, 640])
def test_last_task_does_not_grow_with_the_tasks_before(spark, parts):
    from pyspark.sql import functions as F

    from salesaudit.plans.ordered import leading

    frame = spark.range(0, 40_000, 1, parts).withColumn("place", F.xxhash64("id"))
    found = leading(frame, [F.asc("place")], 50)
    assert [row["id"] for row in found.collect()] == [row["id"] for row in frame.orderBy("place").limit(50).collect()]
    assert _rows_in_last_task(leading(frame, [F.asc("place")], 50)) <= 50 * 64
    plan = executed(leading(frame, [F.asc("place")], 50))
    assert plan.count("WindowGroupLimit") >= 4


def test_identifier_counts_combine_before_the_shuffle(sales):
    plan = executed(audit.identifier_uniqueness(sales))
    assert "partial_count(1)" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(position#\d+, value#", plan)) == 1
    assert len(IDENTIFIERS) == 7


def test_no_query_pairs_rows_without_a_key(spark):
    for name, query in QUERIES.items():
        if name in ("ingest_csv", "read_result"):
            continue
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_hot_order_is_split_in_the_star_join(spark):
    """A third of the lines on one order: AQE splits that join partition."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "32",
    }
    folder = new_folder(spark, "hot")
    lines = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet")
    hot = F.when(F.abs(F.hash("l_partkey", "l_suppkey")) % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("bigint")).repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    for table in ("orders", "part"):
        spark.read.parquet(f"{DATA}/sf0.01/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        columns = ["internal_account_id", "transaction_date", "total_payment"]
        frame = audit.account_activity(star_sales(spark, folder, columns), top=None)
        assert "skew=true" in executed(frame)
        assert frame.agg(F.sum("transactions")).first()[0] == star_sales(spark, folder, columns).where(
            "internal_account_id IS NOT NULL"
        ).count()
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_whole_audit_scans_the_table_eight_times(spark, sales, monkeypatch):
    from salesaudit.plans import audit as plan_of_audit

    found, real = {}, plan_of_audit.save_result

    def counted(frame, folder, name, **options):
        found[name] = len(re.findall(r"FileScan[^\n]*/wide-", executed(frame)))
        return real(frame, folder, name, **options)

    monkeypatch.setattr(plan_of_audit, "save_result", counted)
    plan_of_audit.run_audit(sales, new_folder(spark, "audit"), as_of="2001-01-01 00:00:00", expected_rows=3)
    assert 0 < sum(found.values()) <= 8, found
    assert max(found.values()) == 1


def test_shared_profiles_give_the_same_reports(sales):
    from pyspark.sql import functions as F

    from salesaudit.operators.trends import PERIODS

    same = lambda a, b: a.schema == b.schema and a.collect() == b.collect()
    dimensions = audit.dimension_profile(sales)
    for operator in (
        audit.product_type_performance,
        audit.sale_type_performance,
        audit.application_channel_performance,
        audit.hospitality_performance,
        audit.price_level_performance,
        audit.price_type_performance,
        audit.transfer_status,
        audit.resale_status,
        audit.product_description_performance,
        audit.missing_by_product_type,
    ):
        one, two = operator(sales), operator(sales, profile=dimensions)
        assert [f.name for f in one.schema] == [f.name for f in two.schema] and one.collect() == two.collect(), operator
    groups = {name: (key(), "transaction_id") for name, (key, _) in PERIODS.items()}
    distinct = audit.distinct_profile(sales, groups | {"sales_rep": (F.col("sales_rep"), "internal_account_id")})
    for operator in (audit.monthly_trend, audit.yearly_trend, audit.sales_rep_performance):
        assert operator(sales).collect() == operator(sales, distinct).collect(), operator
    accounts, payments = audit.account_totals(sales), audit.payment_frequencies(sales)
    assert same(audit.account_activity(sales), audit.account_activity(sales, accounts=accounts))
    assert same(audit.revenue_concentration(sales), audit.revenue_concentration(sales, accounts=accounts))
    assert same(audit.high_value_transactions(sales), audit.high_value_transactions(sales, payments=payments))
    assert same(audit.account_activity(sales, 20), audit.account_activity(sales, 20, accounts))


def test_one_shuffle_serves_all_dimensions(sales):
    plan = executed(audit.dimension_profile(sales))
    assert scans(plan) == 1 and plan.count("Exchange") == 1 and "Expand" not in plan
