"""Chart-ready data and report tables made of display text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesaudit.functions.exprs import (
    cell_text,
    count_text,
    mean,
    money_text,
    null_label,
    percent_text,
    to_number,
)
from salesaudit.operators.breakdown import (
    application_channel_performance,
    product_type_performance,
)
from salesaudit.operators.missing import missing_by_column
from salesaudit.operators.overview import STATISTICS_POINTS, payment_percentiles
from salesaudit.operators.trends import month_of

# Chart labels of the percentiles, in order.
PERCENTILE_LABELS = {
    "p01": "P01",
    "p05": "P05",
    "p25": "P25",
    "median_payment": "Median",
    "p75": "P75",
    "p90": "P90",
    "p95": "P95",
    "p99": "P99",
}


def payment_percentiles_long(sales: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """The percentiles as (position, percentile, payment) lines, in order."""
    ranks = statistics or payment_percentiles(sales, **STATISTICS_POINTS)
    pairs = [
        F.struct(F.lit(label).alias("percentile"), F.col(name).alias("payment"))
        for name, label in PERCENTILE_LABELS.items()
    ]
    long = ranks.select(F.posexplode(F.array(*pairs)).alias("at", "pair"))
    return long.select((F.col("at") + 1).alias("position"), "pair.*").orderBy("position")


def label_values(result: DataFrame, label: Column, **series: tuple[Column, Column | None]) -> DataFrame:
    """Points of one or more series from one pass over a report.

    A series is its value and what puts its points in rising order, None for
    falling values. What is not a number is dropped.
    """
    points = []
    for name, (value, place) in series.items():
        number = to_number(value)
        points.append(
            F.struct(
                F.lit(name).alias("series"),
                (-number if place is None else place.cast("double")).alias("place"),
                label.cast("string").alias("label"),
                number.alias("value"),
            )
        )
    return result.select(F.inline(F.array(*points))).where(F.col("value").isNotNull())


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum("total_payment").alias("paid"),
        F.count("total_payment").alias("payments"),
    ]


def _period_points(sales: DataFrame) -> DataFrame:
    """Years and months from one pass: each row counts in both groupings."""
    sold = F.col("transaction_date")
    dated = sales.where(sold.isNotNull()).select(
        "total_payment", F.year(sold).alias("year"), month_of(sold).alias("month")
    )
    periods = dated.groupingSets([[F.col("year")], [F.col("month")]], "year", "month").agg(*_totals())
    year, month = F.col("year"), F.col("month")
    in_year, in_month = year.isNotNull(), month.isNotNull()
    average = mean(F.col("paid"), F.col("payments"))
    place = F.coalesce(year, F.unix_date(month))
    return label_values(
        periods,
        F.coalesce(year.cast("string"), month.cast("string")),
        yearly_revenue=(F.when(in_year, F.col("paid")), place),
        yearly_records=(F.when(in_year, F.col("rows")), place),
        yearly_records_top=(F.when(in_year, F.col("rows")), place),
        monthly_revenue=(F.when(in_month, F.col("paid")), place),
        monthly_records=(F.when(in_month, F.col("rows")), place),
        monthly_average=(F.when(in_month, average), place),
    )


def _group_points(sales: DataFrame) -> DataFrame:
    """Product types and channels from one pass."""
    dimensions = ["product_type", "application_channel"]
    pairs = sales.select("total_payment", *dimensions).unpivot(["total_payment"], dimensions, "dimension", "group")
    groups = pairs.groupBy("dimension", "group").agg(*_totals())
    is_product = F.col("dimension") == "product_type"
    return label_values(
        groups,
        null_label(F.col("group")),
        product_revenue=(F.when(is_product, F.col("paid")), None),
        product_records=(F.when(is_product, F.col("rows")), None),
        channel_revenue=(F.when(~is_product, F.col("paid")), None),
    )


def chart_series(
    sales: DataFrame,
    statistics: DataFrame | None = None,
    missing: DataFrame | None = None,
    shown: Mapping[str, int] | None = None,
) -> DataFrame:
    """The data behind every chart: (series, position, label, value) lines.

    All points, numbered within their series; ``shown`` is how many first ones
    to give of the series that it names.
    Four passes: periods, groups, percentiles, missing values. What is numbered
    here are report lines (types, channels, periods, columns), never rows.
    """
    share, count = F.col("missing_percentage"), F.col("missing_count")
    reports = [
        _period_points(sales),
        _group_points(sales),
        label_values(
            payment_percentiles_long(sales, statistics),
            F.col("percentile"),
            payment_percentiles=(F.col("payment"), F.col("position")),
        ),
        label_values(
            missing or missing_by_column(sales),
            F.col("column_name"),
            missing_share=(share, share),
            missing_count=(count, None),
        ),
    ]
    in_series = Window.partitionBy("series").orderBy("place", "label")
    points = reduce(DataFrame.unionByName, reports).withColumn("position", F.row_number().over(in_series))
    for name, top in (shown or {}).items():
        points = points.where((F.col("series") != name) | (F.col("position") <= top))
    return points.select("series", "position", "label", "value").orderBy("series", "position")


def _report(performance: DataFrame, dimension: str) -> DataFrame:
    return performance.select(
        cell_text(F.col(dimension)).alias(dimension),
        count_text(F.col("records")).alias("records"),
        money_text(F.col("revenue")).alias("revenue"),
        money_text(F.col("average_payment")).alias("average_payment"),
        percent_text(F.col("revenue_percentage")).alias("revenue_share"),
    )


def report_product(sales: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Product types as display text."""
    return _report(performance or product_type_performance(sales), "product_type")


def report_channel(sales: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Channels as display text."""
    return _report(performance or application_channel_performance(sales), "application_channel")
