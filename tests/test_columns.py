"""Column names and types of every report, in order."""

from __future__ import annotations

import pytest

import salesaudit as audit

AS_OF = {"as_of": "2025-01-01 00:00:00"}
MEANS = "revenue double, average_payment double"
SHARED = "records bigint, record_percentage double, revenue double, revenue_percentage double, average_payment double"
BASIC = f"records bigint, record_percentage double, {MEANS}"
PAYMENTS = "minimum_payment double, maximum_payment double"
RANKS = ("p75 double, p90 double, p95 double, p99 double")
SIGNS = "null_payments bigint, zero_payments bigint, negative_payments bigint"
OVER = "payments_over_10000 bigint, payments_over_50000 bigint, payments_over_100000 bigint"
DATES = (
    "missing_transaction_date bigint, missing_last_touched_at bigint, transaction_after_last_touch bigint, "
    "transaction_before_2010 bigint"
)
SPAN = "earliest_transaction timestamp_ntz, latest_transaction timestamp_ntz"
STRUCTURAL = ", ".join(
    f"missing_{name} bigint"
    for name in ("primary_ticket_id", "subscription_instance_id", "section", "row", "seat")
)

# The reports' columns.
REPORTS = {
    audit.dataset_overview: "total_rows bigint, rows_with_payment bigint, rows_with_transaction_date bigint, "
    f"{SPAN}, total_revenue double, average_payment double, {PAYMENTS}, payment_stddev double, "
    "null_payment bigint, zero_payment bigint, negative_payment bigint",
    audit.dataset_overview_basic: f"total_rows bigint, rows_with_payment bigint, {SPAN}, total_payment double, "
    f"average_payment double, {PAYMENTS}, null_payment bigint, zero_payment bigint, negative_payment bigint",
    audit.dataset_coverage: "total_rows bigint, first_transaction timestamp_ntz, "
    "last_transaction timestamp_ntz, distinct_transactions bigint, distinct_products bigint",
    audit.payment_sign_counts: "zero_payment_rows bigint, negative_payment_rows bigint, "
    "positive_payment_rows bigint, null_payment_rows bigint",
    audit.financial_anomalies: f"{SIGNS}, {OVER}, negative_payment_value double, zero_payment_value double, "
    "payments_over_100000_value double",
    audit.financial_anomaly_counts: f"negative_payments bigint, zero_payments bigint, {OVER}",
    audit.financial_anomalies_nonneg: f"{SIGNS}, {OVER}, nonnegative_payments bigint, "
    "negative_payment_value double, zero_payment_value double",
    audit.payment_statistics: "non_null_payments bigint, minimum_payment double, p01 double, p05 double, "
    f"p25 double, median_payment double, {RANKS}, mean_payment double, payment_standard_deviation double, "
    "maximum_payment double",
    audit.payment_analysis: f"transaction_count bigint, total_revenue double, average_payment double, {PAYMENTS}, "
    f"p01 double, p05 double, q1 double, median double, q3 double, {RANKS.removeprefix('p75 double, ')}",
    audit.date_consistency: f"{DATES}, {SPAN}",
    audit.date_consistency_future: f"{DATES}, transaction_in_future bigint",
    audit.date_consistency_full: f"{DATES}, transaction_in_future bigint, {SPAN}",
    audit.missing_by_column: "column_name string, missing_count bigint, missing_percentage double",
    audit.missing_long: "column string, missing_count bigint, missing_percentage double",
    audit.missing_long_nulls: "field string, missing_count bigint, missing_percent double",
    audit.missing_by_product_type: f"product_type string, total_records bigint, {STRUCTURAL}",
    audit.missing_by_product_type_nb: f"product_type string, total_rows bigint, {STRUCTURAL}",
    audit.identifier_uniqueness: "identifier string, total_rows bigint, non_null_rows bigint, "
    "distinct_values bigint, repeated_value_count bigint",
    audit.identifier_uniqueness_wide: "total_rows bigint, unique_primary_ticket_ids bigint, "
    "unique_subscription_instance_ids bigint, unique_sales_item_ids bigint, unique_product_item_ids bigint, "
    "unique_transaction_ids bigint, unique_product_ids bigint",
    audit.duplicate_identifier_summary: "identifier string, duplicate_rows bigint, repeated_rows bigint",
    audit.duplicate_transactions: "transaction_id string, record_count bigint, combined_payment double, "
    "first_transaction timestamp_ntz, last_transaction timestamp_ntz",
    audit.duplicate_sales_items: "sales_item_id string, occurrences bigint",
    audit.duplicate_transaction_ids: "transaction_id string, occurrences bigint",
    audit.duplicate_primary_tickets: "primary_ticket_id string, occurrences bigint",
    audit.duplicate_summary: "identifier string, duplicate_groups bigint",
    audit.duplicate_group_summary: "identifier string, duplicate_rows bigint, duplicate_groups bigint",
    audit.duplicate_transaction_rows: "duplicate_transaction_groups bigint, rows_in_duplicate_groups bigint",
    audit.potential_data_grain: "product_type string, sale_type string, records bigint, "
    "unique_primary_ticket_ids bigint, unique_sales_item_ids bigint, unique_transaction_ids bigint, "
    "unique_subscription_instances bigint, revenue double",
    audit.product_type_performance: f"product_type string, {SHARED}, {PAYMENTS}",
    audit.sale_type_performance: f"sale_type string, {SHARED}",
    audit.application_channel_performance: f"application_channel string, {SHARED}",
    audit.hospitality_performance: f"hospitality_status string, records bigint, {MEANS}",
    audit.price_level_performance: f"price_level string, records bigint, {MEANS}",
    audit.price_type_performance: f"price_type string, records bigint, {MEANS}",
    audit.sales_rep_performance: f"sales_rep string, records bigint, {MEANS}, accounts bigint",
    audit.transfer_status: f"transfer_status string, records bigint, {MEANS}",
    audit.resale_status: f"resale_status string, records bigint, {MEANS}",
    audit.product_description_performance: f"product_description string, records bigint, {MEANS}",
    audit.product_type_basic: f"product_type string, {BASIC}",
    audit.sale_type_basic: f"sale_type string, {BASIC}",
    audit.application_channel_basic: f"application_channel string, {BASIC}",
    audit.hospitality_basic: f"hospitality_status string, records bigint, {MEANS}",
    audit.top_product_descriptions: f"product_description string, records bigint, {MEANS}",
    audit.transfer_status_basic: "transfer_status string, records bigint, revenue double",
    audit.resale_status_basic: "resale_status string, records bigint, revenue double",
    audit.product_summary: f"product_type string, transactions bigint, {MEANS}, {PAYMENTS}",
    audit.channel_summary: f"application_channel string, transactions bigint, {MEANS}",
    audit.sale_type_summary: f"sale_type string, transactions bigint, {MEANS}",
    audit.hospitality_summary: f"is_hospitality boolean, transactions bigint, {MEANS}",
    audit.top_price_levels: f"price_level string, transactions bigint, {MEANS}",
    audit.top_price_types: f"price_type string, transactions bigint, {MEANS}",
    audit.top_sales_reps: f"sales_rep string, transactions bigint, {MEANS}",
    audit.monthly_trend: f"month date, records bigint, {MEANS}, unique_transactions bigint",
    audit.yearly_trend: f"year int, records bigint, {MEANS}, unique_transactions bigint",
    audit.monthly_basic: f"month date, records bigint, {MEANS}",
    audit.yearly_basic: f"year int, records bigint, {MEANS}",
    audit.monthly_sales: f"transaction_month timestamp_ntz, transactions bigint, {MEANS}",
    audit.yearly_sales: f"year int, transactions bigint, {MEANS}",
    audit.yearly_totals: "year int, transactions bigint, total_payment double",
    audit.monthly_trend_flagged: f"month date, records bigint, {MEANS}, unique_transactions bigint, "
    "is_partial boolean",
    audit.account_activity: f"internal_account_id string, transactions bigint, {MEANS}, "
    "first_transaction timestamp_ntz, last_transaction timestamp_ntz",
    audit.revenue_concentration: "internal_account_id string, revenue double, revenue_percentage double, "
    "cumulative_revenue_percentage double",
    audit.business_issues: "category string, severity string, issue string, evidence string, "
    "business_impact string, recommended_action string",
    audit.executive_kpis: "metric string, value double",
    audit.audit_flags: "area string, status string, finding string",
    audit.quality_scorecard: "area string, status string, finding string, recommendation string",
    audit.executive_summary: "metric string, value string",
}
NEEDS_NOW = {
    audit.date_consistency_future,
    audit.date_consistency_full,
    audit.quality_scorecard,
    audit.executive_summary,
}


@pytest.mark.parametrize("operator", REPORTS, ids=lambda f: getattr(f, "__name__", ""))
def test_columns(make, operator):
    report = operator(make(), **(AS_OF if operator in NEEDS_NOW else {}))
    assert ", ".join(f"{name} {kind}" for name, kind in report.dtypes) == REPORTS[operator]


def test_wide_missing_reports(make):
    wide = audit.missing_wide(make()).columns
    assert (len(wide), wide[0], wide[1], wide[-2:]) == (
        27,
        "total_rows",
        "primary_ticket_id_missing",
        ["application_channel_missing", "hospitality_null"],
    )
    nulls = audit.missing_wide_nulls(make()).columns
    assert (len(nulls), nulls[0], nulls[1], nulls[-1]) == (
        21,
        "total_rows",
        "missing_primary_ticket_id",
        "missing_is_hospitality",
    )
