"""Row-level lists of bounded length: largest payments and a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesaudit.functions.exprs import as_double, ascending, attach, named
from salesaudit.operators.inventory import type_name
from salesaudit.plans.ordered import cut_off, frequencies, leading

# Columns of the two lists of large payments.
HIGH_VALUE = (
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
)
LARGEST = (
    "transaction_date",
    "total_payment",
    "product_type",
    "sale_type",
    "product_description",
    "application_channel",
    "primary_ticket_id",
    "transaction_id",
    "sales_item_id",
)


def _largest(sales: DataFrame, columns: tuple[str, ...], top: int, payments: DataFrame | None) -> DataFrame:
    """Equal payments are ordered by the other listed columns.

    The ``top``-th largest payment is found first, from how often each occurs;
    the other columns are read for rows from there on. Those are merged level
    by level, since many may equal the last payment.
    """
    rest = [name for name in columns if name != "total_payment"]
    cut = cut_off(payments or frequencies(sales, "total_payment"), top)
    rows = attach(sales.where(F.col("total_payment").isNotNull()).select(*columns), cut=cut)
    rows = rows.where(F.col("total_payment") >= F.col("cut.amount")).drop("cut")
    rows = leading(rows, [F.desc("total_payment"), *ascending(*rest)], top)
    return rows.withColumn("total_payment", as_double(F.col("total_payment")))


def high_value_transactions(sales: DataFrame, top: int = 500, payments: DataFrame | None = None) -> DataFrame:
    """``payments`` is a kept :func:`payment_frequencies`."""
    return _largest(sales, HIGH_VALUE, top, payments)


def largest_transactions(sales: DataFrame, top: int = 100, payments: DataFrame | None = None) -> DataFrame:
    return _largest(sales, LARGEST, top, payments)


def raw_sample(sales: DataFrame, rows: int = 1_000) -> DataFrame:
    """A bounded sample for inspection: the first rows by sales item id, then
    by every other column, so that it is the same each time. Money is a double,
    as in every result.

    One pass that sorts nothing: each task holds no more than its first rows,
    and one task takes the first of those.
    """
    first = [name for name in ("sales_item_id",) if name in sales.columns]
    rest = [name for name in sales.columns if name not in first]
    sample = sales.orderBy(*(named(name).asc_nulls_last() for name in first + rest)).limit(rows)
    money = [f.name for f in sales.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return sample.withColumns({name: as_double(named(name)) for name in money})


def sample_profile(sales: DataFrame, rows: int = 1_000) -> DataFrame:
    """Non-NULL count and type of each column of the sample."""
    fields = sales.schema.fields
    counts = raw_sample(sales, rows).agg(*(F.count(named(f.name)).alias(f.name) for f in fields))
    lines = F.array(
        *(
            F.struct(
                F.lit(position).alias("ordinal_position"),
                F.lit(f.name).alias("column_name"),
                named(f.name).alias("non_null_count"),
                F.lit(type_name(f.dataType)).alias("data_type"),
            )
            for position, f in enumerate(fields, start=1)
        )
    )
    return counts.select(F.inline(lines)).orderBy("ordinal_position")
