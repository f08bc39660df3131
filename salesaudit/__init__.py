"""Audit and revenue summaries of one large sales table, on Spark DataFrames."""

from salesaudit.operators.accounts import (
    account_activity,
    account_totals,
    revenue_concentration,
    revenue_concentration_full,
)
from salesaudit.operators.breakdown import (
    application_channel_basic,
    application_channel_performance,
    breakdown,
    channel_summary,
    dimension_profile,
    distinct_profile,
    hospitality_basic,
    hospitality_performance,
    hospitality_summary,
    price_level_performance,
    price_type_performance,
    product_description_performance,
    product_summary,
    product_type_basic,
    product_type_performance,
    resale_status,
    resale_status_basic,
    sale_type_basic,
    sale_type_performance,
    sale_type_summary,
    sales_rep_performance,
    top_groups,
    top_price_levels,
    top_price_types,
    top_product_descriptions,
    top_sales_reps,
    transfer_status,
    transfer_status_basic,
)
from salesaudit.operators.findings import (
    audit_flags,
    audit_summary,
    business_issues,
    executive_kpis,
    executive_summary,
    quality_scorecard,
    row_count_reconciliation,
)
from salesaudit.operators.identifiers import (
    duplicate_group_summary,
    duplicate_identifier_summary,
    duplicate_primary_tickets,
    duplicate_sales_items,
    duplicate_summary,
    duplicate_transaction_ids,
    duplicate_transaction_rows,
    duplicate_transactions,
    duplicate_values,
    identifier_profile,
    identifier_uniqueness,
    identifier_uniqueness_wide,
    potential_data_grain,
)
from salesaudit.operators.inventory import column_inventory, column_schema, column_types
from salesaudit.operators.missing import (
    missing_by_column,
    missing_by_product_type,
    missing_by_product_type_nb,
    missing_long,
    missing_long_nulls,
    missing_wide,
    missing_wide_nulls,
)
from salesaudit.operators.overview import (
    dataset_coverage,
    dataset_overview,
    dataset_overview_basic,
    date_consistency,
    date_consistency_full,
    date_consistency_future,
    financial_anomalies,
    financial_anomalies_nonneg,
    financial_anomaly_counts,
    payment_analysis,
    payment_frequencies,
    payment_percentiles,
    payment_sign_counts,
    payment_statistics,
    table_facts,
    transaction_id_excess,
    whole_table,
)
from salesaudit.operators.rows import (
    high_value_transactions,
    largest_transactions,
    raw_sample,
    sample_profile,
)
from salesaudit.operators.series import (
    chart_series,
    payment_percentiles_long,
    report_channel,
    report_product,
)
from salesaudit.operators.trends import (
    monthly_basic,
    monthly_sales,
    monthly_trend,
    monthly_trend_flagged,
    yearly_basic,
    yearly_sales,
    yearly_totals,
    yearly_trend,
)
from salesaudit.sources.tables import ingest_csv, load_sales, read_result, save_result
