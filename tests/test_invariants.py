"""Relations between reports that hold for any table."""

from __future__ import annotations

from decimal import Decimal

import pytest
from places import DATA
from pyspark.sql import functions as F

import salesaudit as audit
from salesaudit.sources.star import star_sales


@pytest.fixture(scope="module", params=["sf0.001", "sf0.1"])
def sales(spark, request):
    return star_sales(spark, f"{DATA}/{request.param}")


@pytest.fixture(scope="module")
def overview(sales):
    return audit.dataset_overview(sales).first()


BREAKDOWNS = (
    audit.product_type_performance,
    audit.sale_type_performance,
    audit.application_channel_performance,
    audit.hospitality_performance,
    audit.price_level_performance,
    audit.price_type_performance,
    audit.sales_rep_performance,
    audit.transfer_status,
    audit.resale_status,
    audit.monthly_trend,
    audit.yearly_trend,
)


def cents(value):
    return Decimal(repr(value)).quantize(Decimal("0.01"))


@pytest.mark.parametrize("operator", BREAKDOWNS, ids=lambda f: f.__name__)
def test_breakdowns_add_up(sales, overview, operator):
    lines = operator(sales).collect()
    if operator in (audit.monthly_trend, audit.yearly_trend):
        # rows without a date are in no period
        overview = audit.dataset_overview(sales.where(F.col("transaction_date").isNotNull())).first()
    assert sum(line["records"] for line in lines) == overview["total_rows"]
    assert sum(cents(line["revenue"] or 0) for line in lines) == cents(overview["total_revenue"])
    if "revenue_percentage" in lines[0]:
        assert sum(line["revenue_percentage"] or 0 for line in lines) == pytest.approx(100, abs=0.001)
        assert sum(line["record_percentage"] for line in lines) == pytest.approx(100, abs=0.001)


def test_identifiers_and_missing_values_add_up(sales, overview):
    missing = {line["column_name"]: line["missing_count"] for line in audit.missing_by_column(sales).collect()}
    for line in audit.identifier_uniqueness(sales).collect():
        assert line["distinct_values"] + line["repeated_value_count"] == line["non_null_rows"]
        assert line["non_null_rows"] + missing[line["identifier"]] == overview["total_rows"]
    by_type = audit.missing_by_product_type(sales).collect()
    for name in ("primary_ticket_id", "subscription_instance_id", "section", "row", "seat"):
        assert sum(line[f"missing_{name}"] for line in by_type) == missing[name]


def test_percentiles_rise_between_the_bounds(sales):
    found = audit.payment_statistics(sales).first()
    ranks = [found[name] for name in ("p01", "p05", "p25", "median_payment", "p75", "p90", "p95", "p99")]
    assert ranks == sorted(ranks)
    assert found["minimum_payment"] <= ranks[0] and ranks[-1] <= found["maximum_payment"]


def test_months_add_up_to_years(sales):
    months = audit.monthly_trend(sales).groupBy(F.year("month").alias("year")).agg(F.sum("records").alias("n"))
    by_month = {line["year"]: line["n"] for line in months.collect()}
    assert by_month == {line["year"]: line["records"] for line in audit.yearly_trend(sales).collect()}


def test_cumulative_share_rises_to_the_whole(sales):
    full = audit.revenue_concentration_full(sales).collect()
    known = [line for line in full if line["revenue"] is not None]
    assert full[: len(full) - len(known)] == [line for line in full if line["revenue"] is None]
    order = [(-line["revenue"], line["internal_account_id"]) for line in known]
    assert order == sorted(order)
    shares = [line["cumulative_revenue_percentage"] for line in known]
    rising = [share for line, share in zip(known, shares) if line["revenue"] >= 0]
    falling = [share for line, share in zip(known, shares) if line["revenue"] < 0]
    assert rising == sorted(rising) and falling == sorted(falling, reverse=True) and shares[-1] == 100.0
    top = audit.revenue_concentration(sales, 50).collect()
    assert top == full[:50]


def test_signs_add_up(sales, overview):
    assert sum(audit.payment_sign_counts(sales).first()) == overview["total_rows"]
