"""Every named query over the star tables, with the sales columns it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import salesaudit as audit
from salesaudit.functions.exprs import as_double
from salesaudit.sources.folders import new_folder
from salesaudit.sources.schema import COLUMNS, IDENTIFIERS, ITEM_IDENTIFIERS, SALES
from salesaudit.sources.star import star_sales
from salesaudit.sources.tables import CSV, ingest_csv, read_result, save_result

Query = Callable[[SparkSession, str], DataFrame]

# Fixed value: row count that the reconciliation queries expect.
EXPECTED_ROWS = 5_335_362

# How many points the published charts show of some series.
SHOWN = {"product_revenue": 15, "product_records": 10, "yearly_records_top": 10, "missing_count": 12}

# Rows of a compressed file of the raw CSV, about 50 MB.
CSV_ROWS = 1_000_000

# The time the star-table queries take for "now"; some sales are later.
AS_OF = "2001-01-01 00:00:00"

PAID = ("total_payment",)
DATES = ("transaction_date", "last_touched_at")
CHANNEL = ("application_channel", *PAID)
PRODUCT = ("product_type", *PAID)


def _over(operator: Callable[..., DataFrame], *columns: str, **parameters) -> Query:
    """The operator over the star tables, joined only for the named columns."""
    return lambda spark, folder: operator(star_sales(spark, folder, columns), **parameters)


def _over_kept(operator: Callable[..., DataFrame], *columns: str, **parameters) -> Query:
    """Like ``_over`` for an operator that reads the table several times: the star tables are joined once."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = save_result(star_sales(spark, folder, columns), new_folder(spark, "joined"), "sales", format="parquet")
        return operator(spark.read.parquet(path), **parameters)

    return query


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Write the sales as raw CSV, load that into a table, total it by year.

    The CSV is compressed, in files small enough to be one task each.
    """
    raw, table = new_folder(spark, "raw-csv"), new_folder(spark, "sales-table")
    sales = star_sales(spark, folder)
    sales = sales.withColumn("last_touched_at", F.col("last_touched_at").cast(SALES["last_touched_at"].dataType))
    sales.write.options(**CSV, compression="gzip", maxRecordsPerFile=CSV_ROWS).csv(raw)
    loaded = ingest_csv(spark, raw, table)
    year = F.year("transaction_date").alias("year")
    totals = loaded.groupBy(year).agg(
        F.count(F.lit(1)).alias("records"),
        F.count("sales_details").alias("rows_with_details"),
        F.count_if(F.trim("sales_details") == "").alias("rows_with_blank_details"),
        F.count("is_hospitality").alias("rows_with_hospitality"),
        F.max("last_touched_at").cast("timestamp_ntz").alias("last_touched"),
        as_double(F.sum("total_payment")).alias("revenue"),
        as_double(F.sum("total_plan_amount")).alias("plan_amount"),
    )
    # The distinct items are counted apart, so that their shuffle carries no totals.
    items = loaded.select(year, "sales_item_id").distinct()
    items = items.groupBy(F.col("year").alias("item_year")).agg(F.count("sales_item_id").alias("sales_items"))
    found = totals.join(items, F.col("year").eqNullSafe(F.col("item_year")))
    return found.select(*totals.columns[:5], "sales_items", *totals.columns[5:])


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Save a report as CSV and read it back."""
    report = audit.monthly_basic(star_sales(spark, folder, ("transaction_date", *PAID)))
    path = save_result(report, new_folder(spark, "results"), "monthly_trend")
    return read_result(spark, path, report.schema)


def _repeated_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with more than one sales line, all of them."""
    return audit.duplicate_values(star_sales(spark, folder, ("internal_account_id",)), "internal_account_id", None)


def _matching_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The reconciliation where the expected count is right: that of the lines."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    return audit.row_count_reconciliation(star_sales(spark, folder, PAID), lines)


QUERIES: dict[str, Query] = {
    # sources and samples
    "ingest_csv": _ingested,
    "read_result": _published,
    "raw_sample": _over(audit.raw_sample, *COLUMNS),
    "sample_profile": _over(audit.sample_profile, *COLUMNS),
    # whole-table profiles
    "dataset_overview": _over(audit.dataset_overview, *PAID, "transaction_date"),
    "dataset_overview_basic": _over(audit.dataset_overview_basic, *PAID, "transaction_date"),
    "dataset_coverage": _over(audit.dataset_coverage, "transaction_date", "transaction_id", "product_id"),
    "transaction_id_excess": _over(
        audit.transaction_id_excess, "transaction_date", "transaction_id", "product_id"
    ),
    "payment_sign_counts": _over(audit.payment_sign_counts, *PAID),
    "financial_anomalies": _over(audit.financial_anomalies, *PAID),
    "financial_anomaly_counts": _over(audit.financial_anomaly_counts, *PAID),
    "financial_anomalies_nonneg": _over(audit.financial_anomalies_nonneg, *PAID),
    "payment_statistics": _over(audit.payment_statistics, *PAID),
    "payment_analysis": _over(audit.payment_analysis, *PAID),
    "date_consistency": _over(audit.date_consistency, *PAID, *DATES),
    "date_consistency_future": _over(audit.date_consistency_future, *PAID, *DATES, as_of=AS_OF),
    "date_consistency_full": _over(audit.date_consistency_full, *PAID, *DATES, as_of=AS_OF),
    # missing values
    "missing_by_column": _over(audit.missing_by_column, *COLUMNS),
    "missing_wide": _over(audit.missing_wide, *COLUMNS),
    "missing_long": _over(audit.missing_long, *COLUMNS),
    "missing_wide_nulls": _over(audit.missing_wide_nulls, *COLUMNS),
    "missing_long_nulls": _over(audit.missing_long_nulls, *COLUMNS),
    "missing_by_product_type": _over(
        audit.missing_by_product_type,
        "product_type",
        "primary_ticket_id",
        "subscription_instance_id",
        "section",
        "row",
        "seat",
    ),
    "missing_by_product_type_nb": _over(
        audit.missing_by_product_type_nb,
        "product_type",
        "primary_ticket_id",
        "subscription_instance_id",
        "section",
        "row",
        "seat",
    ),
    # identifiers
    "identifier_uniqueness": _over(audit.identifier_uniqueness, *IDENTIFIERS),
    "identifier_uniqueness_wide": _over(audit.identifier_uniqueness_wide, *ITEM_IDENTIFIERS),
    "duplicate_identifier_summary": _over(audit.duplicate_identifier_summary, *IDENTIFIERS),
    "duplicate_transactions": _over(
        audit.duplicate_transactions, "transaction_id", "transaction_date", *PAID
    ),
    "duplicate_sales_items": _over(audit.duplicate_sales_items, "sales_item_id"),
    "duplicate_transaction_ids": _over(audit.duplicate_transaction_ids, "transaction_id"),
    "duplicate_primary_tickets": _over(audit.duplicate_primary_tickets, "primary_ticket_id"),
    "all_duplicate_transactions": _over(
        audit.duplicate_transactions, "transaction_id", "transaction_date", *PAID, top=None
    ),
    "all_duplicate_sales_items": _over(audit.duplicate_sales_items, "sales_item_id", top=None),
    "all_duplicate_transaction_ids": _over(audit.duplicate_transaction_ids, "transaction_id", top=None),
    "all_duplicate_primary_tickets": _over(audit.duplicate_primary_tickets, "primary_ticket_id", top=None),
    "all_repeated_accounts": _repeated_accounts,
    "duplicate_summary": _over(
        audit.duplicate_summary, "sales_item_id", "transaction_id", "primary_ticket_id"
    ),
    "duplicate_group_summary": _over(audit.duplicate_group_summary, *ITEM_IDENTIFIERS),
    "duplicate_transaction_rows": _over(audit.duplicate_transaction_rows, "transaction_id"),
    "potential_data_grain": _over(
        audit.potential_data_grain,
        "product_type",
        "sale_type",
        "primary_ticket_id",
        "sales_item_id",
        "transaction_id",
        "subscription_instance_id",
        *PAID,
    ),
    # breakdowns
    "product_type_performance": _over(audit.product_type_performance, *PRODUCT),
    "sale_type_performance": _over(audit.sale_type_performance, "sale_type", *PAID),
    "application_channel_performance": _over(audit.application_channel_performance, *CHANNEL),
    "hospitality_performance": _over(audit.hospitality_performance, "is_hospitality", *PAID),
    "price_level_performance": _over(audit.price_level_performance, "price_level", *PAID),
    "price_type_performance": _over(audit.price_type_performance, "price_type", *PAID),
    "sales_rep_performance": _over(
        audit.sales_rep_performance, "sales_rep", "internal_account_id", *PAID
    ),
    "transfer_status": _over(audit.transfer_status, "transfer_status", *PAID),
    "resale_status": _over(audit.resale_status, "resale_status", *PAID),
    "product_description_performance": _over(
        audit.product_description_performance, "product_description", *PAID
    ),
    "product_type_basic": _over(audit.product_type_basic, *PRODUCT),
    "sale_type_basic": _over(audit.sale_type_basic, "sale_type", *PAID),
    "application_channel_basic": _over(audit.application_channel_basic, *CHANNEL),
    "hospitality_basic": _over(audit.hospitality_basic, "is_hospitality", *PAID),
    "top_product_descriptions": _over(audit.top_product_descriptions, "product_description", *PAID),
    "transfer_status_basic": _over(audit.transfer_status_basic, "transfer_status", *PAID),
    "resale_status_basic": _over(audit.resale_status_basic, "resale_status", *PAID),
    "product_summary": _over(audit.product_summary, *PRODUCT),
    "channel_summary": _over(audit.channel_summary, *CHANNEL),
    "sale_type_summary": _over(audit.sale_type_summary, "sale_type", *PAID),
    "hospitality_summary": _over(audit.hospitality_summary, "is_hospitality", *PAID),
    "top_price_levels": _over(audit.top_price_levels, "price_level", *PAID),
    "top_price_types": _over(audit.top_price_types, "price_type", *PAID),
    "top_sales_reps": _over(audit.top_sales_reps, "sales_rep", *PAID),
    "top_groups": _over(audit.top_groups, "product_type", *CHANNEL),
    # trends
    "monthly_trend": _over(audit.monthly_trend, "transaction_date", "transaction_id", *PAID),
    "yearly_trend": _over(audit.yearly_trend, "transaction_date", "transaction_id", *PAID),
    "monthly_basic": _over(audit.monthly_basic, "transaction_date", *PAID),
    "yearly_basic": _over(audit.yearly_basic, "transaction_date", *PAID),
    "monthly_sales": _over(audit.monthly_sales, "transaction_date", *PAID),
    "yearly_sales": _over(audit.yearly_sales, "transaction_date", *PAID),
    "yearly_totals": _over(audit.yearly_totals, "transaction_date", *PAID),
    "monthly_trend_flagged": _over(
        audit.monthly_trend_flagged, "transaction_date", "transaction_id", *PAID
    ),
    # accounts and large payments
    "account_activity": _over(
        audit.account_activity, "internal_account_id", "transaction_date", *PAID
    ),
    "revenue_concentration": _over(audit.revenue_concentration, "internal_account_id", *PAID),
    "revenue_concentration_full": _over(audit.revenue_concentration_full, "internal_account_id", *PAID),
    "high_value_transactions": _over(
        audit.high_value_transactions,
        "transaction_id",
        "transaction_date",
        "product_type",
        "sale_type",
        "application_channel",
        "product_description",
        "primary_ticket_id",
        "subscription_instance_id",
        "internal_account_id",
        *PAID,
    ),
    "largest_transactions": _over(
        audit.largest_transactions,
        "transaction_date",
        "product_type",
        "sale_type",
        "product_description",
        "application_channel",
        "primary_ticket_id",
        "transaction_id",
        "sales_item_id",
        *PAID,
    ),
    # findings
    "row_count_reconciliation": _over(audit.row_count_reconciliation, *PAID, expected_rows=EXPECTED_ROWS),
    "row_count_reconciliation_match": _matching_rows,
    "business_issues": _over(
        audit.business_issues,
        "primary_ticket_id",
        "subscription_instance_id",
        "transaction_id",
        "transaction_date",
        *PAID,
        as_of=AS_OF,
        expected_rows=EXPECTED_ROWS,
    ),
    "executive_kpis": _over(
        audit.executive_kpis,
        "primary_ticket_id",
        "subscription_instance_id",
        "transaction_id",
        "transaction_date",
        *PAID,
        as_of=AS_OF,
        expected_rows=EXPECTED_ROWS,
    ),
    "audit_flags": _over(audit.audit_flags, "primary_ticket_id", "is_hospitality", *PAID),
    "quality_scorecard": _over(
        audit.quality_scorecard, *ITEM_IDENTIFIERS, *PAID, *DATES, as_of=AS_OF
    ),
    "executive_summary": _over(
        audit.executive_summary, *ITEM_IDENTIFIERS, *PAID, *DATES, as_of=AS_OF
    ),
    "audit_summary": _over_kept(
        audit.audit_summary, "transaction_id", "product_id", "product_type", "transaction_date", *CHANNEL
    ),
    # chart data and report tables
    "payment_percentiles_long": _over(audit.payment_percentiles_long, *PAID),
    "chart_series": _over(audit.chart_series, *COLUMNS),
    "chart_series_shown": _over(audit.chart_series, *COLUMNS, shown=SHOWN),
    "report_product": _over(audit.report_product, *PRODUCT),
    "report_channel": _over(audit.report_channel, *CHANNEL),
}
