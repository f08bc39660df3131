"""Missing values: per column, wide and long, and by product type.

Each per-column report is one aggregate over the table, then a reshape of its
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesaudit.functions.exprs import (
    ascending,
    count_share,
    existing,
    is_blank,
    named,
    raw_share,
    with_optional,
)

# Columns of the wide report of the earlier audit, in its order.
# It leaves the account id out and reports the hospitality flag under another name.
BLANK_AWARE = (
    "primary_ticket_id",
    "subscription_instance_id",
    "sales_item_id",
    "product_item_id",
    "transaction_id",
    "product_id",
    "sales_rep",
    "transaction_date",
    "last_touched_at",
    "item_type",
    "product_type",
    "sale_type",
    "transfer_status",
    "resale_status",
    "sales_details",
    "price_level",
    "price_type",
    "price_type_group",
    "total_payment",
    "total_plan_amount",
    "section",
    "row",
    "seat",
    "product_description",
    "application_channel",
)

# Columns of the notebook's wide report, in its order.
NULL_ONLY = (
    "primary_ticket_id",
    "subscription_instance_id",
    "sales_item_id",
    "product_item_id",
    "transaction_id",
    "product_id",
    "transaction_date",
    "total_payment",
    "product_type",
    "application_channel",
    "section",
    "row",
    "seat",
    "product_description",
    "sales_rep",
    "sale_type",
    "price_level",
    "price_type",
    "price_type_group",
    "is_hospitality",
)

# Fields whose missingness depends on the product type.
STRUCTURAL = ("primary_ticket_id", "subscription_instance_id", "section", "row", "seat")


def _rows() -> Column:
    return F.count(F.lit(1))


def _nulls(name: str) -> Column:
    return F.count_if(named(name).isNull())


def missing_counters(sales: DataFrame) -> list[Column]:
    """Aggregates ``null <column>``, and ``blank <column>`` for text columns."""
    text = [f.name for f in sales.schema.fields if isinstance(f.dataType, T.StringType)]
    return [_nulls(name).alias(f"null {name}") for name in sales.columns] + [
        F.count_if(is_blank(named(name))).alias(f"blank {name}") for name in text
    ]


def missing_counts(sales: DataFrame) -> DataFrame:
    """One row: the number of rows and every missing count.

    The reports project it; Spark drops the counters a report does not use.
    """
    return sales.agg(_rows().alias("total_rows"), *missing_counters(sales))


def _missing(counts: DataFrame, name: str) -> Column:
    """NULL values, and for a text column also blank ones."""
    nulls, blanks = named(f"null {name}"), f"blank {name}"
    return nulls + named(blanks) if blanks in counts.columns else nulls


def missing_by_column(sales: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """NULL count and share of every column of the table, most missing first."""
    counts = counts or missing_counts(sales)
    wide = counts.select(
        F.col("total_rows").alias("total rows"), *(named(f"null {n}").alias(n) for n in sales.columns)
    )
    return _lines(wide, "column_name").select(
        "column_name",
        "missing_count",
        count_share(F.col("missing_count"), named("total rows")).alias("missing_percentage"),
    )


def missing_wide(sales: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Missing counts side by side; blank text counts as missing."""
    counts = counts or missing_counts(sales)
    columns = [_missing(counts, n).alias(f"{n}_missing") for n in existing(sales, BLANK_AWARE)]
    if "is_hospitality" in sales.columns:
        columns.append(named("null is_hospitality").alias("hospitality_null"))
    return counts.select("total_rows", *columns)


def missing_long(sales: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The wide report by line, with its line for the rows themselves."""
    wide = missing_wide(sales, counts)
    return _shares(wide.withColumn("total rows", F.col("total_rows")), "column", "missing_percentage")


def missing_wide_nulls(sales: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """NULL counts side by side."""
    counts = counts or missing_counts(sales)
    names = existing(sales, NULL_ONLY)
    return counts.select("total_rows", *(named(f"null {n}").alias(f"missing_{n}") for n in names))


def missing_long_nulls(sales: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    wide = missing_wide_nulls(sales, counts).withColumnRenamed("total_rows", "total rows")
    return _shares(wide, "field", "missing_percent")


def _lines(wide: DataFrame, label: str) -> DataFrame:
    """Every count but ``total rows`` as a line, most missing first."""
    names = [name for name in wide.columns if name != "total rows"]
    lines = wide.unpivot([named("total rows")], [named(n) for n in names], label, "missing_count")
    return lines.orderBy(F.desc("missing_count"), label)


def _shares(wide: DataFrame, label: str, share: str) -> DataFrame:
    return _lines(wide, label).select(
        label, "missing_count", raw_share(F.col("missing_count"), named("total rows")).alias(share)
    )


def missing_by_product_type(
    sales: DataFrame, total: str = "total_records", profile: DataFrame | None = None
) -> DataFrame:
    """Missing structural fields per product type. ``profile`` is a kept dimension profile."""
    if profile is not None:
        groups = profile.where(F.col("dimension") == "product_type").select(
            F.col("value").alias("product_type"),
            F.col("rows").alias(total),
            *(named(f"null {name}").alias(f"missing_{name}") for name in STRUCTURAL),
        )
    else:
        groups = with_optional(sales, "product_type").groupBy("product_type").agg(
            _rows().alias(total), *(_nulls(name).alias(f"missing_{name}") for name in STRUCTURAL)
        )
    return groups.orderBy(F.desc(total), *ascending("product_type"))


def missing_by_product_type_nb(sales: DataFrame) -> DataFrame:
    return missing_by_product_type(sales, total="total_rows")
