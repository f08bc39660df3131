"""Records and revenue by month and by year. Periods without sales get no line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesaudit.functions.exprs import as_double, mean
from salesaudit.operators.breakdown import breakdown


def month_of(moment: Column) -> Column:
    return F.date_trunc("month", moment).cast("date")


def _dated(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("transaction_date").isNotNull())


def _trend(sales: DataFrame, key: Column, name: str, **parameters) -> DataFrame:
    return breakdown(
        sales, "transaction_date", key=key, name=name, label="no", order="key", **parameters
    )


def _transactions() -> dict[str, Column]:
    return {"unique_transactions": F.countDistinct("transaction_id")}


# Periods of the trends with distinct transactions, as dimensions of a distinct profile: expression and type.
PERIODS = {
    "month": (lambda: month_of(F.col("transaction_date")), "date"),
    "year": (lambda: F.year("transaction_date"), "int"),
}


def _period(sales: DataFrame, name: str, profile: DataFrame | None) -> DataFrame:
    """The trend by month or year, from the table or from a kept distinct profile over :data:`PERIODS`."""
    key, kind = PERIODS[name]
    if profile is None:
        return _trend(_dated(sales), key(), name, extras=_transactions())
    periods = profile.where((F.col("dimension") == name) & F.col("value").isNotNull())
    return periods.select(
        F.col("value").cast(kind).alias(name),
        F.col("rows").alias("records"),
        as_double(F.col("paid")).alias("revenue"),
        mean(F.col("paid"), F.col("payments")).alias("average_payment"),
        F.col("different").alias("unique_transactions"),
    ).orderBy(name)


def monthly_trend(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return _period(sales, "month", profile)


def yearly_trend(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return _period(sales, "year", profile)


def monthly_basic(sales: DataFrame) -> DataFrame:
    return _trend(_dated(sales), month_of(F.col("transaction_date")), "month", digits=2)


def yearly_basic(sales: DataFrame) -> DataFrame:
    return _trend(_dated(sales), F.year("transaction_date"), "year", digits=2)


def monthly_sales(sales: DataFrame) -> DataFrame:
    """Months as timestamps; rows without a date are a group of their own."""
    month = F.date_trunc("month", F.col("transaction_date")).cast("timestamp_ntz")
    return _trend(sales, month, "transaction_month", count="transactions")


def yearly_sales(sales: DataFrame) -> DataFrame:
    return _trend(sales, F.year("transaction_date"), "year", count="transactions")


def yearly_totals(sales: DataFrame) -> DataFrame:
    return _trend(
        sales, F.year("transaction_date"), "year", count="transactions", revenue="total_payment", average=False
    )


def monthly_trend_flagged(sales: DataFrame) -> DataFrame:
    """The monthly trend with ``is_partial``: the last month, if its last day
    has no sales yet. There are no more months than the calendar has, so one
    task may look at all of them."""
    latest = {"latest": F.max("transaction_date").cast("date")}
    month = month_of(F.col("transaction_date"))
    trend = _trend(_dated(sales), month, "month", extras=_transactions() | latest)
    last = F.max("latest").over(Window.partitionBy())
    is_partial = (F.col("month") == F.trunc(last, "month")) & (last < F.last_day(last))
    return trend.withColumn("is_partial", is_partial).drop("latest").orderBy("month")
