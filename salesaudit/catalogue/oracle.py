"""The same queries as SQL over the star tables, for a second engine.

Written apart from the operators, to check them. Percentages and rounded means
are computed half up in whole numbers, since that engine divides decimals as
doubles.
"""

from __future__ import annotations

from salesaudit.catalogue.queries import AS_OF, EXPECTED_ROWS, SHOWN
from salesaudit.sources.schema import COLUMNS, IDENTIFIERS, ITEM_IDENTIFIERS
from salesaudit.sources.star import star_sql

P = "total_payment"
PAID = f"CAST(SUM({P}) AS DOUBLE)"
MEAN = f"CAST(SUM({P}) AS DOUBLE) / NULLIF(COUNT({P}), 0)"
CENTS = f"CAST(SUM({P}) * 100 AS HUGEINT)"
MEAN_2 = f"CAST((2 * {CENTS} + COUNT({P})) // (2 * NULLIF(COUNT({P}), 0)) AS DOUBLE) / 100"


def _share(part: str, whole: str, digits: int = 4) -> str:
    """100 * part / whole of whole numbers, rounded half up."""
    scale = 10**digits
    part, whole = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    return f"CAST(({200 * scale} * {part} + {whole}) // NULLIF(2 * {whole}, 0) AS DOUBLE) / {scale}"


def _number(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def _money(value: str) -> str:
    return f"COALESCE('$' || format('{{:,.2f}}', CAST({value} AS DOUBLE)), '$0.00')"


# --- whole-table profiles -------------------------------------------------

OVERVIEW = f"""
COUNT(*) AS total_rows, COUNT({P}) AS rows_with_payment,
MIN(transaction_date) AS earliest_transaction, MAX(transaction_date) AS latest_transaction,
{MEAN} AS average_payment, CAST(MIN({P}) AS DOUBLE) AS minimum_payment,
CAST(MAX({P}) AS DOUBLE) AS maximum_payment,
COUNT(*) FILTER (WHERE {P} IS NULL) AS null_payment, COUNT(*) FILTER (WHERE {P} = 0) AS zero_payment,
COUNT(*) FILTER (WHERE {P} < 0) AS negative_payment"""

OVER = ", ".join(
    f"COUNT(*) FILTER (WHERE {P} > {limit}) AS payments_over_{limit}" for limit in (10000, 50000, 100000)
)
SIGNS = f"""COUNT(*) FILTER (WHERE {P} = 0) AS zero_payments, COUNT(*) FILTER (WHERE {P} < 0) AS negative_payments"""
NULLS = f"COUNT(*) FILTER (WHERE {P} IS NULL) AS null_payments"
VALUES = f"""
CAST(SUM({P}) FILTER (WHERE {P} < 0) AS DOUBLE) AS negative_payment_value,
CAST(SUM({P}) FILTER (WHERE {P} = 0) AS DOUBLE) AS zero_payment_value"""

DATES = """
COUNT(*) FILTER (WHERE transaction_date IS NULL) AS missing_transaction_date,
COUNT(*) FILTER (WHERE last_touched_at IS NULL) AS missing_last_touched_at,
COUNT(*) FILTER (WHERE transaction_date > last_touched_at) AS transaction_after_last_touch,
COUNT(*) FILTER (WHERE transaction_date < TIMESTAMP '2010-01-01 00:00:00') AS transaction_before_2010"""
SPAN = "MIN(transaction_date) AS earliest_transaction, MAX(transaction_date) AS latest_transaction"
FUTURE = f"COUNT(*) FILTER (WHERE transaction_date > TIMESTAMP '{AS_OF}') AS transaction_in_future"


def _percentile(point: float, name: str) -> str:
    return f"quantile_cont(CAST({P} AS DOUBLE), {point}) AS {name}"


POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
STATISTIC_NAMES = ("p01", "p05", "p25", "median_payment", "p75", "p90", "p95", "p99")
ANALYSIS_NAMES = ("p01", "p05", "q1", "median", "q3", "p90", "p95", "p99")
LABELS = ("P01", "P05", "P25", "Median", "P75", "P90", "P95", "P99")


def _percentiles(names: tuple[str, ...]) -> str:
    return ", ".join(_percentile(point, name) for point, name in zip(POINTS, names))


PROFILES = {
    "dataset_overview": f"""SELECT {OVERVIEW}, COUNT(transaction_date) AS rows_with_transaction_date,
        {PAID} AS total_revenue, STDDEV_POP(CAST({P} AS DOUBLE)) AS payment_stddev FROM sales""",
    "dataset_overview_basic": f"SELECT {OVERVIEW}, {PAID} AS total_payment FROM sales",
    "dataset_coverage": """SELECT COUNT(*) AS total_rows, MIN(transaction_date) AS first_transaction,
        MAX(transaction_date) AS last_transaction, COUNT(DISTINCT transaction_id) AS distinct_transactions,
        COUNT(DISTINCT product_id) AS distinct_products FROM sales""",
    "transaction_id_excess": """SELECT COUNT(*) AS total_rows,
        COUNT(DISTINCT transaction_id) AS distinct_transactions,
        COUNT(*) - COUNT(DISTINCT transaction_id) AS duplicate_difference FROM sales""",
    "payment_sign_counts": f"""SELECT COUNT(*) FILTER (WHERE {P} = 0) AS zero_payment_rows,
        COUNT(*) FILTER (WHERE {P} < 0) AS negative_payment_rows,
        COUNT(*) FILTER (WHERE {P} > 0) AS positive_payment_rows,
        COUNT(*) FILTER (WHERE {P} IS NULL) AS null_payment_rows FROM sales""",
    "financial_anomalies": f"""SELECT {NULLS}, {SIGNS}, {OVER}, {VALUES},
        CAST(SUM({P}) FILTER (WHERE {P} > 100000) AS DOUBLE) AS payments_over_100000_value FROM sales""",
    "financial_anomaly_counts": f"SELECT {SIGNS}, {OVER} FROM sales",
    "financial_anomalies_nonneg": f"""SELECT {NULLS}, {SIGNS}, {OVER}, {VALUES},
        COUNT(*) FILTER (WHERE {P} >= 0) AS nonnegative_payments FROM sales""",
    "payment_statistics": f"""SELECT COUNT({P}) AS non_null_payments,
        CAST(MIN({P}) AS DOUBLE) AS minimum_payment, {_percentiles(STATISTIC_NAMES)},
        {MEAN} AS mean_payment, STDDEV_POP(CAST({P} AS DOUBLE)) AS payment_standard_deviation,
        CAST(MAX({P}) AS DOUBLE) AS maximum_payment FROM sales WHERE {P} IS NOT NULL""",
    "payment_analysis": f"""SELECT COUNT(*) AS transaction_count, {PAID} AS total_revenue,
        {MEAN} AS average_payment, CAST(MIN({P}) AS DOUBLE) AS minimum_payment,
        CAST(MAX({P}) AS DOUBLE) AS maximum_payment, {_percentiles(ANALYSIS_NAMES)} FROM sales""",
    "date_consistency": f"SELECT {DATES}, {SPAN} FROM sales",
    "date_consistency_future": f"SELECT {DATES}, {FUTURE} FROM sales",
    "date_consistency_full": f"SELECT {DATES}, {FUTURE}, {SPAN} FROM sales",
}

# --- missing values -------------------------------------------------------

NOT_TEXT = ("transaction_date", "last_touched_at", "total_payment", "total_plan_amount", "is_hospitality")
BLANK_AWARE = [name for name in COLUMNS if name not in ("internal_account_id", "is_hospitality")]
NULL_ONLY = [
    name
    for name in COLUMNS
    if name
    not in (
        "internal_account_id",
        "last_touched_at",
        "item_type",
        "transfer_status",
        "resale_status",
        "sales_details",
        "total_plan_amount",
    )
]


def _missing(name: str) -> str:
    blank = "" if name in NOT_TEXT else f" OR TRIM(\"{name}\") = ''"
    return f'COUNT(*) FILTER (WHERE "{name}" IS NULL{blank})'


def _null(name: str) -> str:
    return f'COUNT(*) FILTER (WHERE "{name}" IS NULL)'


MISSING_WIDE = {"total_rows": "COUNT(*)"} | {f"{n}_missing": _missing(n) for n in BLANK_AWARE}
MISSING_WIDE |= {"hospitality_null": _null("is_hospitality")}
MISSING_NULLS = {"total_rows": "COUNT(*)"} | {f"missing_{n}": _null(n) for n in NULL_ONLY}


def _wide(counts: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f'{count} AS "{name}"' for name, count in counts.items()) + " FROM sales"


def _long(counts: dict[str, str], label: str, share: str) -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{name}' AS \"{label}\", {count} AS missing_count, COUNT(*) AS n FROM sales"
        for name, count in counts.items()
    )
    ratio = "CAST(missing_count AS DOUBLE) / NULLIF(n, 0) * 100"
    return f', lines AS ({lines}) SELECT "{label}", missing_count, {ratio} AS {share} FROM lines'


def _by_column() -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {_null(name)} AS missing_count, COUNT(*) AS n FROM sales"
        for name in COLUMNS
    )
    return f""", lines AS ({lines})
        SELECT column_name, missing_count, {_share('missing_count', 'n')} AS missing_percentage FROM lines"""


def _by_product(total: str) -> str:
    fields = ("primary_ticket_id", "subscription_instance_id", "section", "row", "seat")
    counts = ", ".join(f"{_null(name)} AS missing_{name}" for name in fields)
    return f"SELECT product_type, COUNT(*) AS {total}, {counts} FROM sales GROUP BY product_type"


MISSING = {
    "missing_by_column": _by_column(),
    "missing_wide": _wide(MISSING_WIDE),
    "missing_long": _long(MISSING_WIDE, "column", "missing_percentage"),
    "missing_wide_nulls": _wide(MISSING_NULLS),
    "missing_long_nulls": _long(
        {name: count for name, count in MISSING_NULLS.items() if name != "total_rows"}, "field", "missing_percent"
    ),
    "missing_by_product_type": _by_product("total_records"),
    "missing_by_product_type_nb": _by_product("total_rows"),
}

# --- identifiers ----------------------------------------------------------


def _each(identifiers: tuple[str, ...], columns: str, where: str = '"{0}" IS NOT NULL') -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS identifier, {columns.format(name)} FROM sales WHERE {where.format(name)}"
        for name in identifiers
    )


def _groups(identifiers: tuple[str, ...], present: bool, *names: str) -> str:
    where = '"{0}" IS NOT NULL' + (" AND TRIM(\"{0}\") <> ''" if present else "")
    counts = ", ".join(f"COUNT(*) AS {name}" for name in names)
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS identifier, {counts} FROM (
            SELECT "{name}" FROM sales WHERE {where.format(name)} GROUP BY "{name}" HAVING COUNT(*) > 1)"""
        for name in identifiers
    )


def _top_values(name: str, limit: str = "LIMIT 1000") -> str:
    return f"""SELECT {name}, COUNT(*) AS occurrences FROM sales
        WHERE {name} IS NOT NULL AND TRIM({name}) <> ''
        GROUP BY {name} HAVING COUNT(*) > 1 ORDER BY occurrences DESC, {name} {limit}"""


def _distinct(name: str) -> str:
    return f"COUNT(DISTINCT NULLIF(TRIM({name}), ''))"


IDENTIFIER_QUERIES = {
    "identifier_uniqueness": _each(
        IDENTIFIERS,
        "COUNT(*) AS total_rows, COUNT({0}) AS non_null_rows, COUNT(DISTINCT {0}) AS distinct_values, "
        "COUNT(*) - COUNT(DISTINCT {0}) AS repeated_value_count",
    ),
    "identifier_uniqueness_wide": "SELECT COUNT(*) AS total_rows, "
    + ", ".join(f"{_distinct(name)} AS unique_{name}s" for name in ITEM_IDENTIFIERS)
    + " FROM sales",
    "duplicate_identifier_summary": _each(
        IDENTIFIERS, "COUNT(*) AS duplicate_rows, COUNT(*) - COUNT(DISTINCT {0}) AS repeated_rows"
    ),
    "duplicate_transactions": f"""SELECT transaction_id, COUNT(*) AS record_count,
        {PAID} AS combined_payment, MIN(transaction_date) AS first_transaction,
        MAX(transaction_date) AS last_transaction FROM sales WHERE transaction_id IS NOT NULL
        GROUP BY transaction_id HAVING COUNT(*) > 1 ORDER BY record_count DESC, transaction_id LIMIT 10000""",
    "all_duplicate_transactions": f"""SELECT transaction_id, COUNT(*) AS record_count,
        {PAID} AS combined_payment, MIN(transaction_date) AS first_transaction,
        MAX(transaction_date) AS last_transaction FROM sales WHERE transaction_id IS NOT NULL
        GROUP BY transaction_id HAVING COUNT(*) > 1""",
    "all_duplicate_sales_items": _top_values("sales_item_id", ""),
    "all_duplicate_transaction_ids": _top_values("transaction_id", ""),
    "all_duplicate_primary_tickets": _top_values("primary_ticket_id", ""),
    "all_repeated_accounts": _top_values("internal_account_id", ""),
    "duplicate_sales_items": _top_values("sales_item_id"),
    "duplicate_transaction_ids": _top_values("transaction_id"),
    "duplicate_primary_tickets": _top_values("primary_ticket_id"),
    "duplicate_summary": _groups(
        ("sales_item_id", "transaction_id", "primary_ticket_id"), True, "duplicate_groups"
    ),
    "duplicate_group_summary": _groups(ITEM_IDENTIFIERS, False, "duplicate_rows", "duplicate_groups"),
    "duplicate_transaction_rows": """SELECT COUNT(*) AS duplicate_transaction_groups,
        CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows_in_duplicate_groups FROM (
            SELECT COUNT(*) AS n FROM sales WHERE transaction_id IS NOT NULL
            GROUP BY transaction_id HAVING COUNT(*) > 1)""",
    "potential_data_grain": f"""SELECT product_type, sale_type, COUNT(*) AS records,
        {_distinct('primary_ticket_id')} AS unique_primary_ticket_ids,
        {_distinct('sales_item_id')} AS unique_sales_item_ids,
        {_distinct('transaction_id')} AS unique_transaction_ids,
        {_distinct('subscription_instance_id')} AS unique_subscription_instances,
        {PAID} AS revenue FROM sales GROUP BY product_type, sale_type""",
}

# --- breakdowns -----------------------------------------------------------

BOUNDS = f"CAST(MIN({P}) AS DOUBLE) AS minimum_payment, CAST(MAX({P}) AS DOUBLE) AS maximum_payment"


def _performance(name: str, extra: str = "") -> str:
    """Both shares; the raw column is grouped, then labelled."""
    return f""", g AS (SELECT {name} AS k, COUNT(*) AS n, {CENTS} AS cents, {PAID} AS revenue,
            {MEAN} AS average_payment{extra} FROM sales GROUP BY {name})
        SELECT COALESCE(k, '[NULL]') AS {name}, n AS records,
            {_share('n', 'SUM(n) OVER ()')} AS record_percentage, revenue,
            {_share('cents', 'SUM(cents) OVER ()')} AS revenue_percentage,
            g.* EXCLUDE (k, n, cents, revenue) FROM g"""


def _labelled(name: str, order: str = "revenue", extra: str = "", limit: str = "") -> str:
    place = f"SUM({P})" if order == "revenue" else "COUNT(*)"
    return f"""SELECT COALESCE({name}, '[NULL]') AS {name}, COUNT(*) AS records, {PAID} AS revenue,
        {MEAN} AS average_payment{extra} FROM sales GROUP BY COALESCE({name}, '[NULL]')
        ORDER BY {place} DESC NULLS FIRST, 1 {limit}"""


def _basic(name: str) -> str:
    share = _share("COUNT(*)", "(SELECT COUNT(*) FROM sales)", 2)
    return f"""SELECT COALESCE({name}, '[NULL]') AS {name}, COUNT(*) AS records,
        {share} AS record_percentage, {PAID} AS revenue, {MEAN_2} AS average_payment
        FROM sales GROUP BY sales.{name}"""


def _status(name: str) -> str:
    return f"""SELECT COALESCE({name}, '[NULL]') AS {name}, COUNT(*) AS records, {PAID} AS revenue
        FROM sales GROUP BY sales.{name}"""


def _summary(name: str, extra: str = "", limit: str = "") -> str:
    return f"""SELECT {name}, COUNT(*) AS transactions, {PAID} AS revenue, {MEAN} AS average_payment{extra}
        FROM sales GROUP BY {name} ORDER BY SUM({P}) DESC NULLS FIRST, {name} NULLS LAST {limit}"""


def _hospitality(true: str, false: str, null: str, mean: str) -> str:
    return f"""SELECT CASE WHEN is_hospitality IS NULL THEN '{null}' WHEN is_hospitality THEN '{true}'
        ELSE '{false}' END AS hospitality_status, COUNT(*) AS records, {PAID} AS revenue,
        {mean} AS average_payment FROM sales GROUP BY 1"""


def _best(name: str) -> str:
    return f"""(SELECT '{name}' AS dimension, {name} AS top_group, {PAID} AS revenue FROM sales
        GROUP BY {name} ORDER BY SUM({P}) DESC NULLS LAST, {name} NULLS LAST LIMIT 1)"""


BREAKDOWNS = {
    "product_type_performance": _performance("product_type", f", {BOUNDS}"),
    "sale_type_performance": _performance("sale_type"),
    "application_channel_performance": _performance("application_channel"),
    "hospitality_performance": _hospitality("Hospitality", "Non-Hospitality", "[NULL]", MEAN),
    "price_level_performance": _labelled("price_level"),
    "price_type_performance": _labelled("price_type"),
    "sales_rep_performance": _labelled(
        "sales_rep", extra=", COUNT(DISTINCT internal_account_id) AS accounts"
    ),
    "transfer_status": _labelled("transfer_status", "records"),
    "resale_status": _labelled("resale_status", "records"),
    "product_description_performance": _labelled("product_description", limit="LIMIT 500"),
    "product_type_basic": _basic("product_type"),
    "sale_type_basic": _basic("sale_type"),
    "application_channel_basic": _basic("application_channel"),
    "hospitality_basic": _hospitality("true", "false", "NULL", MEAN_2),
    "top_product_descriptions": f"""SELECT product_description, COUNT(*) AS records, {PAID} AS revenue,
        {MEAN_2} AS average_payment FROM sales
        WHERE product_description IS NOT NULL AND TRIM(product_description) <> ''
        GROUP BY product_description ORDER BY records DESC, product_description LIMIT 100""",
    "transfer_status_basic": _status("transfer_status"),
    "resale_status_basic": _status("resale_status"),
    "product_summary": _summary("product_type", f", {BOUNDS}"),
    "channel_summary": _summary("application_channel"),
    "sale_type_summary": _summary("sale_type"),
    "hospitality_summary": _summary("is_hospitality"),
    "top_price_levels": _summary("price_level", limit="LIMIT 25"),
    "top_price_types": _summary("price_type", limit="LIMIT 25"),
    "top_sales_reps": _summary("sales_rep", limit="LIMIT 20"),
    "top_groups": f"{_best('product_type')} UNION ALL {_best('application_channel')}",
}

# --- trends ---------------------------------------------------------------

MONTH = "CAST(DATE_TRUNC('month', transaction_date) AS DATE)"
YEAR = "CAST(EXTRACT(YEAR FROM transaction_date) AS INTEGER)"
TRANSACTIONS = ", COUNT(DISTINCT transaction_id) AS unique_transactions"


def _trend(key: str, name: str, mean: str, extra: str = "", dated: bool = True, count: str = "records") -> str:
    where = "WHERE transaction_date IS NOT NULL" if dated else ""
    return f"""SELECT {key} AS "{name}", COUNT(*) AS {count}, {PAID} AS revenue,
        {mean} AS average_payment{extra} FROM sales {where} GROUP BY 1"""


LAST_DAY = "(SELECT CAST(MAX(transaction_date) AS DATE) FROM sales)"

TRENDS = {
    "monthly_trend": _trend(MONTH, "month", MEAN, TRANSACTIONS),
    "yearly_trend": _trend(YEAR, "year", MEAN, TRANSACTIONS),
    "monthly_basic": _trend(MONTH, "month", MEAN_2),
    "yearly_basic": _trend(YEAR, "year", MEAN_2),
    "monthly_sales": _trend(
        "DATE_TRUNC('month', CAST(transaction_date AS TIMESTAMP))",
        "transaction_month",
        MEAN,
        dated=False,
        count="transactions",
    ),
    "yearly_sales": _trend(YEAR, "year", MEAN, dated=False, count="transactions"),
    "yearly_totals": f"""SELECT {YEAR} AS "year", COUNT(*) AS transactions, {PAID} AS total_payment
        FROM sales GROUP BY 1""",
    "monthly_trend_flagged": f""", t AS ({_trend(MONTH, 'month', MEAN, TRANSACTIONS)})
        SELECT t.*, "month" = CAST(DATE_TRUNC('month', {LAST_DAY}) AS DATE)
            AND {LAST_DAY} < LAST_DAY({LAST_DAY}) AS is_partial FROM t""",
}

# --- accounts and rows ----------------------------------------------------

ACCOUNT = "internal_account_id"
RANKED = f""", a AS (SELECT {ACCOUNT}, CAST(SUM({P}) * 100 AS HUGEINT) AS cents, {PAID} AS revenue
        FROM sales WHERE {ACCOUNT} IS NOT NULL GROUP BY {ACCOUNT}),
    r AS (SELECT *, SUM(cents) OVER (ORDER BY cents DESC NULLS FIRST, {ACCOUNT} NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
        SUM(cents) OVER () AS total FROM a)
    SELECT {ACCOUNT}, revenue, {_share('cents', 'total')} AS revenue_percentage,
        {_share('so_far', 'total')} AS cumulative_revenue_percentage FROM r
    ORDER BY cents DESC NULLS FIRST, {ACCOUNT}"""


def _largest(columns: list[str], limit: int) -> str:
    rest = [name for name in columns if name != P]
    order = ", ".join(f"{name} NULLS LAST" for name in rest)
    return f"""SELECT {', '.join(rest)}, CAST({P} AS DOUBLE) AS {P} FROM sales
        WHERE {P} IS NOT NULL ORDER BY sales.{P} DESC, {order} LIMIT {limit}"""


SAMPLE_ORDER = ", ".join(
    f'sales."{name}" NULLS LAST'
    for name in ["sales_item_id", *(name for name in COLUMNS if name != "sales_item_id")]
)
SAMPLE = f"""SELECT * REPLACE (CAST(total_payment AS DOUBLE) AS total_payment,
    CAST(total_plan_amount AS DOUBLE) AS total_plan_amount) FROM sales ORDER BY {SAMPLE_ORDER} LIMIT 1000"""
SAMPLE_TYPES = {
    "transaction_date": "timestamp without time zone",
    "last_touched_at": "timestamp without time zone",
    "total_payment": "numeric",
    "total_plan_amount": "numeric",
    "is_hospitality": "boolean",
}

ROWS = {
    "account_activity": f"""SELECT {ACCOUNT}, COUNT(*) AS transactions, {PAID} AS revenue,
        {MEAN} AS average_payment, MIN(transaction_date) AS first_transaction,
        MAX(transaction_date) AS last_transaction FROM sales WHERE {ACCOUNT} IS NOT NULL
        GROUP BY {ACCOUNT} ORDER BY SUM({P}) DESC NULLS FIRST, {ACCOUNT} LIMIT 10000""",
    "revenue_concentration": f"{RANKED} LIMIT 10000",
    "revenue_concentration_full": RANKED,
    "high_value_transactions": _largest(
        [
            "transaction_id",
            "transaction_date",
            "product_type",
            "sale_type",
            "application_channel",
            "product_description",
            "total_payment",
            "primary_ticket_id",
            "subscription_instance_id",
            "internal_account_id",
        ],
        500,
    ),
    "largest_transactions": _largest(
        [
            "transaction_date",
            "total_payment",
            "product_type",
            "sale_type",
            "product_description",
            "application_channel",
            "primary_ticket_id",
            "transaction_id",
            "sales_item_id",
        ],
        100,
    ),
    "raw_sample": SAMPLE,
    "sample_profile": f", sample AS ({SAMPLE}) "
    + " UNION ALL ".join(
        f"""SELECT {position} AS ordinal_position, '{name}' AS column_name,
            COUNT("{name}") AS non_null_count, '{SAMPLE_TYPES.get(name, "text")}' AS data_type FROM sample"""
        for position, name in enumerate(COLUMNS, start=1)
    ),
    "ingest_csv": f"""SELECT {YEAR} AS "year", COUNT(*) AS records,
        COUNT(sales_details) AS rows_with_details,
        COUNT(*) FILTER (WHERE TRIM(sales_details) = '') AS rows_with_blank_details,
        COUNT(is_hospitality) AS rows_with_hospitality, COUNT(DISTINCT sales_item_id) AS sales_items,
        MAX(last_touched_at) AS last_touched, {PAID} AS revenue,
        CAST(SUM(total_plan_amount) AS DOUBLE) AS plan_amount FROM sales GROUP BY 1""",
    "read_result": _trend(MONTH, "month", MEAN_2),
}

# --- findings -------------------------------------------------------------

FACTS = f"""f AS (SELECT COUNT(*) AS n, COUNT({P}) AS paid, SUM({P}) AS revenue,
    MIN({P}) AS low, MAX({P}) AS high, {MEAN} AS average,
    COUNT(*) FILTER (WHERE {P} IS NULL) AS nulls, COUNT(*) FILTER (WHERE {P} = 0) AS zeros,
    COUNT(*) FILTER (WHERE {P} < 0) AS negatives, COUNT(*) FILTER (WHERE {P} > 100000) AS high_values,
    COUNT(*) FILTER (WHERE transaction_date > TIMESTAMP '{AS_OF}') AS future,
    COUNT(*) FILTER (WHERE transaction_date > last_touched_at) AS disorder,
    COUNT(*) FILTER (WHERE primary_ticket_id IS NULL) AS no_ticket,
    COUNT(*) FILTER (WHERE subscription_instance_id IS NULL) AS no_subscription,
    COUNT(*) FILTER (WHERE primary_ticket_id IS NULL OR TRIM(primary_ticket_id) = '') AS blank_ticket,
    COUNT(*) FILTER (WHERE is_hospitality IS NULL) AS no_hospitality,
    MIN(transaction_date) AS first, MAX(transaction_date) AS last,
    CAST(MAX(transaction_date) AS DATE) AS last_day FROM sales)"""

REPEATED = """d AS (SELECT COUNT(*) AS repeated FROM (SELECT transaction_id FROM sales
    WHERE transaction_id IS NOT NULL GROUP BY transaction_id HAVING COUNT(*) > 1))"""


def _issue(category: str, severity: str, issue: str, evidence: str, impact: str, action: str, fires: str) -> str:
    return f"""SELECT '{category}' AS category, '{severity}' AS severity, {issue} AS issue,
        {evidence} AS evidence, '{impact}' AS business_impact, {action} AS recommended_action
        FROM f, d WHERE {fires}"""


ROW_ISSUES = [
    _issue(
        "Data completeness",
        "INFO",
        "'Dataset row count matches the verified updated dataset.'",
        f"{_number('n')} || ' records audited.'",
        "Supports confidence in the current database load.",
        "'Retain this dataset as the current audit baseline.'",
        f"n = {EXPECTED_ROWS}",
    ),
    _issue(
        "Data completeness",
        "HIGH",
        "'Dataset row count differs from the verified baseline.'",
        f"'Found ' || {_number('n')} || '; expected ' || {_number(str(EXPECTED_ROWS))} || '.'",
        "Analysis may not represent the complete source dataset.",
        "'Reconcile the source file and database load.'",
        f"n <> {EXPECTED_ROWS}",
    ),
]

ISSUES = [
    *ROW_ISSUES,
    _issue(
        "Revenue data",
        "HIGH",
        "'Payment values are missing.'",
        f"{_number('nulls')} || ' records have NULL total_payment.'",
        "Revenue reporting may be incomplete.",
        "'Investigate missing payment records.'",
        "nulls > 0",
    ),
    _issue(
        "Revenue data",
        "REVIEW",
        "'Zero-payment transactions exist.'",
        f"{_number('zeros')} || ' records have a zero payment.'",
        "May represent complimentary, adjusted, test, or non-revenue transactions.",
        "'Classify zero-payment transactions by business purpose.'",
        "zeros > 0",
    ),
    _issue(
        "Revenue data",
        "HIGH",
        "'Negative payment values exist.'",
        f"{_number('negatives')} || ' records have negative payments.'",
        "Could affect revenue reporting and reconciliation.",
        "'Reconcile negative values against refunds, credits, or reversals.'",
        "negatives > 0",
    ),
    _issue(
        "Transaction monitoring",
        "REVIEW",
        "'Very high-value transactions require validation.'",
        f"{_number('high_values')} || ' transactions exceed $100,000.'",
        "Unusual values can materially affect aggregate revenue.",
        "'Validate high-value transactions against source-system records.'",
        "high_values > 0",
    ),
    _issue(
        "Date quality",
        "HIGH",
        "'Future transaction dates were detected.'",
        f"{_number('future')} || ' records occur after the audit timestamp.'",
        "Can distort reporting periods and forecasting.",
        "'Investigate timestamp generation and source-system clocks.'",
        "future > 0",
    ),
    *(
        _issue(
            "Data completeness",
            "REVIEW",
            f"'Missing {name} values exist.'",
            f"{_number(count)} || ' records are missing the identifier.'",
            "May affect customer, ticket, or subscription-level analysis.",
            "'Interpret missingness by product type before labeling it as an error.'",
            f"{count} > 0",
        )
        for name, count in (
            ("primary_ticket_id", "no_ticket"),
            ("subscription_instance_id", "no_subscription"),
        )
    ),
    _issue(
        "Reporting period",
        "INFO",
        "strftime(last, '%B %Y') || ' is a partial month.'",
        "'The latest transaction date is ' || strftime(last, '%B %-d, %Y') || '.'",
        "Monthly comparisons can be misleading if partial periods are treated as complete.",
        "'Flag ' || strftime(last, '%B %Y') || ' as partial in dashboards and reports.'",
        "last_day < LAST_DAY(last_day)",
    ),
    _issue(
        "Duplicate transactions",
        "REVIEW",
        "'Repeated transaction IDs were detected.'",
        f"{_number('repeated')} || ' duplicate transaction groups are present in the table.'",
        "Could represent legitimate multi-line transactions or duplicate records.",
        "'Investigate transaction grain before deduplicating.'",
        "repeated > 0",
    ),
]


def _lines(source: str, lines: dict[str, str], names: tuple[str, str] = ("metric", "value")) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS {names[0]}, {value} AS {names[1]} FROM {source}" for label, value in lines.items()
    )


def _flag(area: str, status: str, finding: str) -> str:
    return f"SELECT '{area}' AS area, {status} AS status, {finding} AS finding FROM f"


def _pass(count: str) -> str:
    return f"CASE WHEN {count} = 0 THEN 'PASS' ELSE 'REVIEW' END"


def _check(area: str, count: str, none: str, some: str, advice: str) -> str:
    return f"""SELECT '{area}' AS area, {_pass(count)} AS status,
        CASE WHEN {count} = 0 THEN '{none}' ELSE {_number(count)} || '{some}' END AS finding,
        CASE WHEN {count} = 0 THEN 'No action required.' ELSE '{advice}' END AS recommendation FROM f"""


CLOCKS = "Investigate timestamp generation and source-system clocks."
GRAIN = "Determine whether repeated identifiers are expected at the dataset''s business grain."
CHECKS = [
    f"""SELECT 'Dataset completeness' AS area, 'PASS' AS status,
        'Dataset contains exactly ' || {_number('n')} || ' rows.' AS finding,
        'Retain the complete dataset as the audit baseline.' AS recommendation FROM f""",
    _check(
        "Payment completeness",
        "nulls",
        "No NULL total_payment values were detected.",
        " NULL total_payment values were detected.",
        "Investigate missing payment records.",
    ),
    _check(
        "Negative payments",
        "negatives",
        "No negative payment values were detected.",
        " negative payment values were detected.",
        "Reconcile negative values against refunds, credits, or reversals.",
    ),
    _check(
        "Zero payments",
        "zeros",
        "No zero-payment records were detected.",
        " zero-payment records were detected.",
        "Determine whether zero values represent complimentary or non-revenue transactions.",
    ),
    _check(
        "Future transactions",
        "future",
        "No transaction dates occur after the current timestamp.",
        " transaction dates occur after the current timestamp.",
        CLOCKS,
    ),
    _check(
        "Date ordering",
        "disorder",
        "No transaction_date values occur after last_touched_at.",
        " transaction_date values occur after last_touched_at.",
        CLOCKS,
    ),
    f"""SELECT 'Identifier: ' || identifier AS area, {_pass('g')} AS status,
        CASE WHEN g = 0 THEN 'No' ELSE {_number('g')} END
            || ' duplicate ' || identifier || ' groups were detected.' AS finding,
        CASE WHEN g = 0 THEN 'No action required.' ELSE '{GRAIN}' END AS recommendation
        FROM ({_groups(ITEM_IDENTIFIERS, False, 'g')})""",
]
SCORECARD = " UNION ALL ".join(CHECKS)

# the mean in ten-thousandths, rounded half up
MEAN_4 = "((CAST(revenue * 100 AS HUGEINT) * 200 + paid) // (2 * paid))"

FINDINGS = {
    "row_count_reconciliation": f", {FACTS}, {REPEATED} " + " UNION ALL ".join(ROW_ISSUES),
    "row_count_reconciliation_match": f", {FACTS}, {REPEATED} "
    + ROW_ISSUES[0].replace(f"n = {EXPECTED_ROWS}", "n = (SELECT COUNT(*) FROM lineitem)"),
    "business_issues": f", {FACTS}, {REPEATED} " + " UNION ALL ".join(ISSUES),
    "executive_kpis": f", {FACTS}, {REPEATED}, i AS ({' UNION ALL '.join(ISSUES)}) "
    + _lines(
        "f",
        {
            "Total records": "CAST(n AS DOUBLE)",
            "Total revenue": "CAST(revenue AS DOUBLE)",
            "Average transaction": "average",
            "Median transaction": f"(SELECT quantile_cont(CAST({P} AS DOUBLE), 0.5) FROM sales)",
            "Maximum transaction": "CAST(high AS DOUBLE)",
            "Zero-payment records": "CAST(zeros AS DOUBLE)",
            "Negative-payment records": "CAST(negatives AS DOUBLE)",
            "Missing-payment records": "CAST(nulls AS DOUBLE)",
            "Business issues identified": "CAST((SELECT COUNT(*) FROM i) AS DOUBLE)",
        },
    ),
    "audit_flags": f", {FACTS} "
    + " UNION ALL ".join(
        [
            _flag("Dataset imported", "'PASS'", f"{_number('n')} || ' rows available'"),
            _flag("Payment completeness", _pass("nulls"), f"{_number('nulls')} || ' NULL payment values'"),
            _flag("Negative payments", _pass("negatives"), f"{_number('negatives')} || ' negative payment values'"),
            _flag("Zero payments", _pass("zeros"), f"{_number('zeros')} || ' zero payment values'"),
            _flag(
                "Primary ticket ID completeness",
                _pass("blank_ticket"),
                f"{_number('blank_ticket')} || ' blank/NULL primary ticket IDs'",
            ),
            _flag(
                "Hospitality field",
                _pass("no_hospitality"),
                f"{_number('no_hospitality')} || ' NULL hospitality values'",
            ),
            _flag(
                "Duplicate identifiers",
                "'REVIEW'",
                "'Repeated identifiers exist. Do not delete records until the dataset grain is established.'",
            ),
            _flag(
                "Row and seat fields",
                "'REVIEWED'",
                "'Fields are stored as text because ticket locations can contain alphanumeric values such as GA1.'",
            ),
        ]
    ),
    "quality_scorecard": f", {FACTS} {SCORECARD}",
    "executive_summary": f", {FACTS}, c AS ({SCORECARD}) "
    + _lines(
        "f",
        {
            "Total rows": "CAST(n AS VARCHAR)",
            "Earliest transaction": "strftime(first, '%Y-%m-%d %H:%M:%S.%f')",
            "Latest transaction": "strftime(last, '%Y-%m-%d %H:%M:%S.%f')",
            "Total payment": "CAST(CAST(revenue AS DECIMAL(28,2)) AS VARCHAR)",
            "Average payment": f"CAST({MEAN_4} // 10000 AS VARCHAR) || '.' || "
            f"LPAD(CAST({MEAN_4} % 10000 AS VARCHAR), 4, '0')",
            "Minimum payment": "CAST(CAST(low AS DECIMAL(28,2)) AS VARCHAR)",
            "Maximum payment": "CAST(CAST(high AS DECIMAL(28,2)) AS VARCHAR)",
            "PASS checks": "CAST((SELECT COUNT(*) FROM c WHERE status = 'PASS') AS VARCHAR)",
            "REVIEW checks": "CAST((SELECT COUNT(*) FROM c WHERE status = 'REVIEW') AS VARCHAR)",
            "FAIL checks": "CAST((SELECT COUNT(*) FROM c WHERE status = 'FAIL') AS VARCHAR)",
        },
    ),
    "audit_summary": f""", {FACTS} SELECT n AS total_rows,
        (SELECT COUNT(DISTINCT transaction_id) FROM sales) AS distinct_transactions,
        first AS first_transaction, last AS last_transaction, CAST(revenue AS DOUBLE) AS total_revenue,
        average AS average_payment,
        (SELECT quantile_cont(CAST({P} AS DOUBLE), 0.5) FROM sales) AS median_payment,
        CAST(low AS DOUBLE) AS minimum_payment, CAST(high AS DOUBLE) AS maximum_payment,
        zeros AS zero_payment_rows, negatives AS negative_payment_rows, nulls AS null_payment_rows,
        (SELECT top_group FROM {_best('product_type')}) AS top_product_type,
        (SELECT top_group FROM {_best('application_channel')}) AS top_application_channel FROM f""",
}
# --- chart data and report tables -----------------------------------------


def _points(series: str, source: str, label: str, value: str, order: str, limit: int | None = None) -> str:
    shown = "" if limit is None else f"WHERE position <= {limit}"
    return f"""SELECT * FROM (SELECT '{series}' AS series,
        CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS position,
        CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM {source}
        WHERE {value} IS NOT NULL) {shown}"""


def _falling(value: str, label: str) -> str:
    return f"{value} DESC, {label}"


PERCENTILE_LINES = " UNION ALL ".join(
    f"""SELECT {position} AS position, '{label}' AS percentile,
        quantile_cont(CAST({P} AS DOUBLE), {point}) AS payment FROM sales"""
    for position, (label, point) in enumerate(zip(LABELS, POINTS), start=1)
)


def _plain(name: str) -> str:
    return f"""SELECT COALESCE({name}, '[NULL]') AS k, COUNT(*) AS records, {PAID} AS revenue
        FROM sales GROUP BY sales.{name}"""


def _charts(shown: dict[str, int]) -> str:
    def points(series: str, *parts: str) -> str:
        return _points(series, *parts, limit=shown.get(series))

    return " UNION ALL ".join(points(*parts) for parts in CHARTS)


CHARTS = [
    ("yearly_revenue", "y", '"year"', "revenue", '"year"'),
    ("yearly_records", "y", '"year"', "records", '"year"'),
    ("yearly_records_top", "y", '"year"', "records", '"year"'),
    ("monthly_revenue", "m", '"month"', "revenue", '"month"'),
    ("monthly_records", "m", '"month"', "records", '"month"'),
    ("monthly_average", "m", '"month"', "average_payment", '"month"'),
    ("product_revenue", "p", "k", "revenue", _falling("revenue", "k")),
    ("product_records", "p", "k", "records", _falling("records", "k")),
    ("channel_revenue", "c", "k", "revenue", _falling("revenue", "k")),
    ("payment_percentiles", "q", "percentile", "payment", "position"),
    ("missing_share", "ms", "column_name", "missing_percentage", "missing_percentage, column_name"),
    ("missing_count", "ms", "column_name", "missing_count", _falling("missing_count", "column_name")),
]


def _report(name: str) -> str:
    share = _share("cents", "SUM(cents) OVER ()")
    return f""", g AS (SELECT {name} AS k, COUNT(*) AS n, {CENTS} AS cents, {PAID} AS revenue,
            {MEAN} AS average FROM sales GROUP BY {name})
        SELECT REPLACE(COALESCE(k, '[NULL]'), '|', '/') AS {name}, {_number('n')} AS records,
            {_money('revenue')} AS revenue, {_money('average')} AS average_payment,
            COALESCE(format('{{:.2f}}', {share}) || '%', '0.00%') AS revenue_share FROM g"""


CHART_TABLES = f""", y AS ({_trend(YEAR, 'year', MEAN)}), m AS ({_trend(MONTH, 'month', MEAN)}),
        p AS ({_plain('product_type')}), c AS ({_plain('application_channel')}), q AS ({PERCENTILE_LINES}),
        lines AS ({' UNION ALL '.join(
            f"SELECT '{name}' AS column_name, {_null(name)} AS missing_count, COUNT(*) AS n FROM sales"
            for name in COLUMNS
        )}),
        ms AS (SELECT column_name, missing_count, {_share('missing_count', 'n')} AS missing_percentage
            FROM lines) """

SERIES = {
    "payment_percentiles_long": PERCENTILE_LINES,
    "chart_series": CHART_TABLES + _charts({}),
    "chart_series_shown": CHART_TABLES + _charts(SHOWN),
    "report_product": _report("product_type"),
    "report_channel": _report("application_channel"),
}


def oracle_sql() -> dict[str, str]:
    """Query name -> complete SQL text."""
    bodies = PROFILES | MISSING | IDENTIFIER_QUERIES | BREAKDOWNS | TRENDS | ROWS | FINDINGS | SERIES
    return {name: star_sql() + body for name, body in bodies.items()}
