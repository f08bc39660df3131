"""Uniqueness of identifiers and their duplicate groups.

Everything rests on one two-step count: rows per (identifier, value), combined
before the shuffle so that a hot value costs one row per task, then groups per
identifier.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.functions.exprs import (
    as_double,
    ascending,
    attach,
    blank_to_null,
    existing,
    is_present,
    named,
    with_optional,
)
from salesaudit.plans.ordered import cut_off, frequencies, leading
from salesaudit.sources.schema import IDENTIFIERS, ITEM_IDENTIFIERS


def identifier_profile(
    sales: DataFrame,
    identifiers: Sequence[str] = IDENTIFIERS,
    value: Callable[[Column], Column] = lambda column: column,
) -> DataFrame:
    """Per identifier that the table has: rows, values and repeated values.

    ``value`` is what counts as the value of a column. An identifier without
    any still gets its line. ``position`` is its place in the given list, and
    what is shuffled instead of its name.
    """
    names = existing(sales, identifiers)
    values = F.array(*(value(named(name)).cast("string") for name in names))
    pairs = sales.select(F.posexplode(values).alias("position", "value"))
    counts = pairs.groupBy("position", "value").agg(F.count(F.lit(1)).alias("rows"))

    seed = sales.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("position"),
        F.lit(None).cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("rows"),
    )
    has_value = F.col("value").isNotNull()
    repeated = has_value & (F.col("rows") > 1)
    return (
        counts.unionByName(seed)
        .groupBy("position")
        .agg(
            F.sum("rows").alias("total_rows"),
            _rows_where(has_value).alias("non_null_rows"),
            F.count("value").alias("distinct_values"),
            F.count_if(repeated).alias("repeated_values"),
            _rows_where(repeated).alias("rows_in_repeated_values"),
        )
        .withColumn("identifier", F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1))
    )


def present_or_null(column: Column) -> Column:
    return F.when(is_present(column), column)


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0).cast("bigint"))


def _repeated_rows() -> Column:
    return F.col("non_null_rows") - F.col("distinct_values")


def identifier_uniqueness(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Distinct and repeated values per identifier, over its non-NULL rows.

    ``total_rows`` equals ``non_null_rows``: the count is taken after the NULL
    filter, and stays in the report under that name.
    """
    return (profile or identifier_profile(sales)).orderBy("position").select(
        "identifier",
        F.col("non_null_rows").alias("total_rows"),
        "non_null_rows",
        "distinct_values",
        _repeated_rows().alias("repeated_value_count"),
    )


def identifier_uniqueness_wide(sales: DataFrame) -> DataFrame:
    """Distinct non-blank values side by side."""
    names = existing(sales, ITEM_IDENTIFIERS)
    profile = identifier_profile(sales, names, blank_to_null)
    return profile.agg(
        F.max("total_rows").alias("total_rows"),
        *(
            F.max(F.when(F.col("identifier") == name, F.col("distinct_values"))).alias(f"unique_{name}s")
            for name in names
        ),
    )


def duplicate_identifier_summary(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Rows beyond the first of each value, per identifier.

    ``duplicate_rows`` is the number of non-NULL rows, under its reported name.
    """
    return (profile or identifier_profile(sales)).orderBy("position").select(
        "identifier", F.col("non_null_rows").alias("duplicate_rows"), _repeated_rows().alias("repeated_rows")
    )


def duplicate_transactions(sales: DataFrame, top: int | None = 10_000) -> DataFrame:
    """The transaction ids with the most rows, with payment and date span;
    ``top=None`` lists all that repeat."""
    sales = with_optional(sales, "transaction_id", "transaction_date").where(F.col("transaction_id").isNotNull())
    repeated = (
        sales.groupBy("transaction_id")
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            as_double(F.sum("total_payment")).alias("combined_payment"),
            F.min("transaction_date").alias("first_transaction"),
            F.max("transaction_date").alias("last_transaction"),
        )
        .where(F.col("record_count") > 1)
    )
    order = [F.desc("record_count"), F.asc("transaction_id")]
    return repeated.orderBy(*order) if top is None else leading(repeated, order, top)


def duplicate_values(sales: DataFrame, identifier: str, top: int | None = 1_000) -> DataFrame:
    """The non-blank values of an identifier that occur most often; ``top=None``
    lists all that repeat."""
    sales = with_optional(sales, identifier)
    repeated = (
        sales.where(is_present(named(identifier)))
        .groupBy(identifier)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )
    return _most_repeated(repeated, "occurrences", identifier, top)


def _most_repeated(values: DataFrame, count: str, key: str, top: int | None) -> DataFrame:
    """The ``top`` values by count, then key; the count of the last of them is found first."""
    order = [F.desc(count), named(key).asc()]
    if top is None:
        return values.orderBy(*order)
    cut = cut_off(frequencies(values, count), top)
    return leading(attach(values, cut=cut).where(F.col(count) >= F.col("cut.amount")).drop("cut"), order, top)


def duplicate_sales_items(sales: DataFrame, top: int | None = 1_000) -> DataFrame:
    return duplicate_values(sales, "sales_item_id", top)


def duplicate_transaction_ids(sales: DataFrame, top: int | None = 1_000) -> DataFrame:
    return duplicate_values(sales, "transaction_id", top)


def duplicate_primary_tickets(sales: DataFrame, top: int | None = 1_000) -> DataFrame:
    return duplicate_values(sales, "primary_ticket_id", top)


def duplicate_summary(sales: DataFrame) -> DataFrame:
    """Repeated non-blank values of three identifiers, all of them counted."""
    names = ("sales_item_id", "transaction_id", "primary_ticket_id")
    return identifier_profile(sales, names, present_or_null).orderBy("position").select(
        "identifier", F.col("repeated_values").alias("duplicate_groups")
    )


def duplicate_group_summary(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Repeated values of the six item identifiers.

    Both value columns hold the number of groups, as the published report does.
    """
    groups = F.col("repeated_values")
    profile = profile or identifier_profile(sales, ITEM_IDENTIFIERS)
    return profile.where(F.col("identifier").isin(*ITEM_IDENTIFIERS)).orderBy("position").select(
        "identifier", groups.alias("duplicate_rows"), groups.alias("duplicate_groups")
    )


def duplicate_transaction_rows(sales: DataFrame) -> DataFrame:
    """How many transaction ids repeat, and how many rows carry them."""
    return identifier_profile(sales, ["transaction_id"]).select(
        F.col("repeated_values").alias("duplicate_transaction_groups"),
        F.col("rows_in_repeated_values").alias("rows_in_duplicate_groups"),
    )


def potential_data_grain(sales: DataFrame) -> DataFrame:
    """Distinct identifiers per product and sale type, to find what a row is.

    Rows are first counted per identifier value, so the few (product type, sale
    type) pairs do not become the few tasks. Records and revenue ride along
    with the first identifier.
    """
    distinct = {
        "unique_primary_ticket_ids": "primary_ticket_id",
        "unique_sales_item_ids": "sales_item_id",
        "unique_transaction_ids": "transaction_id",
        "unique_subscription_instances": "subscription_instance_id",
    }
    pair = ("product_type", "sale_type")
    sales = with_optional(sales, *pair, *distinct.values())
    values = F.array(*(blank_to_null(F.col(column)) for column in distinct.values()))
    rows = sales.select(*pair, "total_payment", F.posexplode(values).alias("position", "value"))
    first = F.col("position") == 0
    counts = rows.groupBy(*pair, "position", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(first, F.col("total_payment"))).alias("paid")
    )
    return (
        counts.groupBy(*pair)
        .agg(
            F.sum(F.when(first, F.col("rows"))).alias("records"),
            *(
                F.count(F.when(F.col("position") == place, F.col("value"))).alias(name)
                for place, name in enumerate(distinct)
            ),
            as_double(F.sum("paid")).alias("revenue"),
        )
        .orderBy(F.desc("records"), *ascending(*pair))
    )
