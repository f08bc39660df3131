"""The whole audit of one sales table, written as a folder of reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import salesaudit as audit
from salesaudit.operators.trends import PERIODS
from salesaudit.sources.tables import save_result


def run_audit(
    sales: DataFrame,
    folder: str,
    as_of: str | datetime | None = None,
    expected_rows: int | None = None,
) -> dict[str, str]:
    """Write every report of the audit to ``folder``; report name -> path.

    The table is scanned eight times, each for a few columns: whole-table counts,
    identifiers, payment frequencies, dimensions, periods and representatives
    with distinct counts, accounts, repeated transactions, largest payments. What
    several reports share is written first and read back by them.
    """
    spark = sales.sparkSession

    def kept(frame: DataFrame, name: str, small: bool = True) -> DataFrame:
        """``frame`` written; a few rows as one file, which keeps their order."""
        frame = frame.coalesce(1) if small else frame
        return spark.read.parquet(save_result(frame, folder, name, format="parquet"))

    facts = kept(audit.whole_table(sales, as_of), "facts")
    profile = kept(audit.identifier_profile(sales), "identifier_profile")
    payments = kept(audit.payment_frequencies(sales), "payment_frequencies", small=False)
    statistics = kept(audit.payment_statistics(sales, payments), "payment_statistics")
    median = statistics.select(F.col("median_payment").alias("median"))
    dimensions = kept(audit.dimension_profile(sales), "dimensions", small=False)
    accounts = kept(audit.account_totals(sales), "accounts", small=False)
    groups = {name: (key(), "transaction_id") for name, (key, _) in PERIODS.items()}
    groups = groups if {"transaction_id", "transaction_date"} <= set(sales.columns) else {}
    if {"sales_rep", "internal_account_id"} <= set(sales.columns):
        groups["sales_rep"] = (F.col("sales_rep"), "internal_account_id")
    distinct = kept(audit.distinct_profile(sales, groups), "distinct", small=False) if groups else None
    periods = distinct if "month" in groups else None
    reps = distinct if "sales_rep" in groups else None

    # Names of the published reports, in order.
    reports = {
        "01_dataset_overview": audit.dataset_overview(sales, facts),
        "02_column_inventory": audit.column_inventory(sales),
        "03_missing_values_by_column": audit.missing_by_column(sales, facts),
        "04_missingness_by_product_type": audit.missing_by_product_type(sales, profile=dimensions),
        "05_identifier_uniqueness": audit.identifier_uniqueness(sales, profile),
        "06_duplicate_identifier_summary": audit.duplicate_identifier_summary(sales, profile),
        "07_duplicate_transactions": audit.duplicate_transactions(sales),
        "08_financial_anomalies": audit.financial_anomalies(sales, facts),
        "09_payment_statistics": statistics,
        "10_high_value_transactions": audit.high_value_transactions(sales, payments=payments),
        "11_product_type_performance": audit.product_type_performance(sales, profile=dimensions),
        "12_sale_type_performance": audit.sale_type_performance(sales, profile=dimensions),
        "13_application_channel_performance": audit.application_channel_performance(sales, profile=dimensions),
        "14_hospitality_performance": audit.hospitality_performance(sales, profile=dimensions),
        "15_price_level_performance": audit.price_level_performance(sales, profile=dimensions),
        "16_price_type_performance": audit.price_type_performance(sales, profile=dimensions),
        "17_sales_representative_performance": audit.sales_rep_performance(sales, reps),
        "18_transfer_status": audit.transfer_status(sales, profile=dimensions),
        "19_resale_status": audit.resale_status(sales, profile=dimensions),
        "20_monthly_trend": audit.monthly_trend(sales, periods),
        "21_yearly_trend": audit.yearly_trend(sales, periods),
        "22_date_consistency": audit.date_consistency(sales, facts),
        "23_product_description_performance": audit.product_description_performance(sales, profile=dimensions),
        "24_top_account_activity": audit.account_activity(sales, accounts=accounts),
        "25_revenue_concentration": audit.revenue_concentration(sales, accounts=accounts),
        "26_business_issue_register": audit.business_issues(sales, expected_rows, as_of, facts, profile),
        "27_executive_kpis": audit.executive_kpis(
            sales, expected_rows, as_of, facts, profile, median
        ),
    }
    return {name: save_result(report, folder, name, one_file=True) for name, report in reports.items()}
