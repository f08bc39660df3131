"""Whole-table profiles: size, dates, payments.

All of them project :func:`table_facts`, one global aggregate. Spark drops the
facts a projection does not use, and with them the columns it need not read;
an audit that wants them all passes the aggregate in and scans once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.functions.exprs import as_double, attach, mean
from salesaudit.operators.missing import missing_counters
from salesaudit.plans.ordered import frequencies, percentiles

# Earliest plausible date and the payment thresholds.
EARLIEST_PLAUSIBLE = "2010-01-01 00:00:00"
THRESHOLDS = (10_000, 50_000, 100_000)

# Names and fractions of the percentiles in the two reports.
STATISTICS_POINTS = {
    "p01": 0.01,
    "p05": 0.05,
    "p25": 0.25,
    "median_payment": 0.5,
    "p75": 0.75,
    "p90": 0.9,
    "p95": 0.95,
    "p99": 0.99,
}
ANALYSIS_POINTS = {
    "p01": 0.01,
    "p05": 0.05,
    "q1": 0.25,
    "median": 0.5,
    "q3": 0.75,
    "p90": 0.9,
    "p95": 0.95,
    "p99": 0.99,
}


def moment(value: str | datetime) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def table_facts(sales: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """One row with every whole-table count, sum and bound.

    Facts about a date column that the table does not have are left out.
    ``as_of`` is the time after which a transaction lies in the future; without
    it nothing does.
    """
    return sales.agg(*fact_columns(sales, as_of))


def whole_table(sales: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """:func:`table_facts` and every missing count, from one pass."""
    return sales.agg(*fact_columns(sales, as_of), *missing_counters(sales))


def fact_columns(sales: DataFrame, as_of: str | datetime | None = None) -> list[Column]:
    """The aggregates of :func:`table_facts`."""
    facts = [F.count(F.lit(1)).alias("total_rows"), *_payment_facts()]
    if "transaction_date" in sales.columns:
        facts += _date_facts(as_of)
    if "last_touched_at" in sales.columns:
        facts.append(F.count_if(F.col("last_touched_at").isNull()).alias("missing_last_touched_at"))
    if {"transaction_date", "last_touched_at"} <= set(sales.columns):
        late = F.col("transaction_date") > F.col("last_touched_at")
        facts.append(F.count_if(late).alias("transaction_after_last_touch"))
    return facts


def _payment_facts() -> list[Column]:
    paid = F.col("total_payment")
    over = {limit: paid > F.lit(limit) for limit in THRESHOLDS}
    return [
        F.count(paid).alias("rows_with_payment"),
        F.sum(paid).alias("revenue"),
        F.min(paid).alias("minimum_payment"),
        F.max(paid).alias("maximum_payment"),
        F.stddev_pop(paid).alias("payment_stddev"),
        F.count_if(paid.isNull()).alias("null_payments"),
        F.count_if(paid == 0).alias("zero_payments"),
        F.count_if(paid < 0).alias("negative_payments"),
        F.count_if(paid > 0).alias("positive_payments"),
        *(F.count_if(over[limit]).alias(f"payments_over_{limit}") for limit in THRESHOLDS),
        F.sum(F.when(paid < 0, paid)).alias("negative_payment_value"),
        F.sum(F.when(paid == 0, paid)).alias("zero_payment_value"),
        F.sum(F.when(over[100_000], paid)).alias("payments_over_100000_value"),
    ]


def _date_facts(as_of: str | datetime | None) -> list[Column]:
    sold = F.col("transaction_date")
    in_future = sold > moment(as_of) if as_of is not None else F.lit(False)
    return [
        F.count(sold).alias("rows_with_transaction_date"),
        F.min(sold).alias("earliest_transaction"),
        F.max(sold).alias("latest_transaction"),
        F.count_if(sold.isNull()).alias("missing_transaction_date"),
        F.count_if(sold < moment(EARLIEST_PLAUSIBLE)).alias("transaction_before_2010"),
        F.count_if(in_future).alias("transaction_in_future"),
    ]


def _money(name: str) -> Column:
    return as_double(F.col(name)).alias(name)


def total_revenue() -> Column:
    return as_double(F.col("revenue"))


def average_payment() -> Column:
    return mean(F.col("revenue"), F.col("rows_with_payment"))


def dataset_overview(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    return (facts or table_facts(sales)).select(
        "total_rows",
        "rows_with_payment",
        "rows_with_transaction_date",
        "earliest_transaction",
        "latest_transaction",
        total_revenue().alias("total_revenue"),
        average_payment().alias("average_payment"),
        _money("minimum_payment"),
        _money("maximum_payment"),
        "payment_stddev",
        F.col("null_payments").alias("null_payment"),
        F.col("zero_payments").alias("zero_payment"),
        F.col("negative_payments").alias("negative_payment"),
    )


def dataset_overview_basic(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The earlier form, whose revenue is called ``total_payment``."""
    overview = dataset_overview(sales, facts).withColumnRenamed("total_revenue", "total_payment")
    return overview.drop("rows_with_transaction_date", "payment_stddev")


def dataset_coverage(sales: DataFrame) -> DataFrame:
    """Rows, dates and two distinct counts from one shuffle of tagged identifiers.

    Rows are counted per (identifier, value) before the shuffle; dates and the
    number of rows ride along with the first identifier.
    """
    values = F.array(F.col("transaction_id").cast("string"), F.col("product_id").cast("string"))
    tagged = sales.select("transaction_date", F.posexplode(values).alias("position", "value"))
    first = F.col("position") == 0
    counts = tagged.groupBy("position", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(first, F.col("transaction_date"))).alias("first"),
        F.max(F.when(first, F.col("transaction_date"))).alias("last"),
    )
    return counts.agg(
        F.coalesce(F.sum(F.when(first, F.col("rows"))), F.lit(0).cast("bigint")).alias("total_rows"),
        F.min("first").alias("first_transaction"),
        F.max("last").alias("last_transaction"),
        F.count(F.when(first, F.col("value"))).alias("distinct_transactions"),
        F.count(F.when(~first, F.col("value"))).alias("distinct_products"),
    )


def transaction_id_excess(sales: DataFrame) -> DataFrame:
    """Rows beyond the number of distinct transaction ids."""
    rows = F.col("total_rows") - F.col("distinct_transactions")
    return dataset_coverage(sales).select(
        "total_rows", "distinct_transactions", rows.alias("duplicate_difference")
    )


def payment_sign_counts(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    return (facts or table_facts(sales)).select(
        F.col("zero_payments").alias("zero_payment_rows"),
        F.col("negative_payments").alias("negative_payment_rows"),
        F.col("positive_payments").alias("positive_payment_rows"),
        F.col("null_payments").alias("null_payment_rows"),
    )


def financial_anomalies(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Counts and values of unusual payments; a value over no rows is NULL."""
    return (facts or table_facts(sales)).select(
        "null_payments",
        "zero_payments",
        "negative_payments",
        "payments_over_10000",
        "payments_over_50000",
        "payments_over_100000",
        _money("negative_payment_value"),
        _money("zero_payment_value"),
        _money("payments_over_100000_value"),
    )


def financial_anomaly_counts(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    return financial_anomalies(sales, facts).select(
        "negative_payments",
        "zero_payments",
        "payments_over_10000",
        "payments_over_50000",
        "payments_over_100000",
    )


def financial_anomalies_nonneg(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The form with the count of payments that are zero or more."""
    return (facts or table_facts(sales)).select(
        "null_payments",
        "zero_payments",
        "negative_payments",
        "payments_over_10000",
        "payments_over_50000",
        "payments_over_100000",
        (F.col("zero_payments") + F.col("positive_payments")).alias("nonnegative_payments"),
        _money("negative_payment_value"),
        _money("zero_payment_value"),
    )


def payment_frequencies(sales: DataFrame) -> DataFrame:
    """(amount, rows) of every payment, NULL included: all payment statistics follow from it."""
    return frequencies(sales, "total_payment")


def payment_percentiles(sales: DataFrame, **points: float) -> DataFrame:
    """One row of exact percentiles of ``total_payment``."""
    return percentiles(payment_frequencies(sales), points)


def _payment_moments(payments: DataFrame) -> DataFrame:
    """One row of counts, exact sum, bounds and standard deviation of :func:`payment_frequencies`.

    The deviation sums squared distances from the mean, which is known first:
    no difference of two large sums.
    """
    amount, rows = F.col("amount"), F.col("rows")
    paid = F.coalesce(F.sum(F.when(amount.isNotNull(), rows)), F.lit(0).cast("bigint"))
    money = F.sum((amount * rows.cast("decimal(18,0)")).cast("decimal(38,2)"))
    level = payments.agg(mean(money, paid).alias("mean"))
    distance = amount.cast("double") - F.col("level.mean")
    return attach(payments, level=level).agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("total_rows"),
        paid.alias("rows_with_payment"),
        money.alias("revenue"),
        F.min("amount").alias("minimum_payment"),
        F.max("amount").alias("maximum_payment"),
        F.sum(distance * distance * rows).alias("squares"),
    )


def payment_statistics(sales: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    """Everything from one frequency table; ``payments`` is a kept :func:`payment_frequencies`."""
    payments = payments or payment_frequencies(sales)
    deviation = F.sqrt(F.col("squares") / F.nullif("rows_with_payment", F.lit(0)))
    return attach(_payment_moments(payments), rank=percentiles(payments, STATISTICS_POINTS)).select(
        F.col("rows_with_payment").alias("non_null_payments"),
        _money("minimum_payment"),
        "rank.*",
        average_payment().alias("mean_payment"),
        deviation.alias("payment_standard_deviation"),
        _money("maximum_payment"),
    )


def payment_analysis(sales: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    payments = payments or payment_frequencies(sales)
    return attach(_payment_moments(payments), rank=percentiles(payments, ANALYSIS_POINTS)).select(
        F.col("total_rows").alias("transaction_count"),
        total_revenue().alias("total_revenue"),
        average_payment().alias("average_payment"),
        _money("minimum_payment"),
        _money("maximum_payment"),
        "rank.*",
    )


def date_consistency(sales: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    return (facts or table_facts(sales)).select(
        "missing_transaction_date",
        "missing_last_touched_at",
        "transaction_after_last_touch",
        "transaction_before_2010",
        "earliest_transaction",
        "latest_transaction",
    )


def date_consistency_future(
    sales: DataFrame, as_of: str | datetime, facts: DataFrame | None = None
) -> DataFrame:
    return date_consistency_full(sales, as_of, facts).drop("earliest_transaction", "latest_transaction")


def date_consistency_full(
    sales: DataFrame, as_of: str | datetime, facts: DataFrame | None = None
) -> DataFrame:
    return (facts or table_facts(sales, as_of)).select(
        "missing_transaction_date",
        "missing_last_touched_at",
        "transaction_after_last_touch",
        "transaction_before_2010",
        "transaction_in_future",
        "earliest_transaction",
        "latest_transaction",
    )
