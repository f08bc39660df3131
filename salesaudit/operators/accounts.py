"""Activity per account and how concentrated revenue is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesaudit.functions.exprs import (
    as_double,
    ascending,
    attach,
    descending,
    mean,
    money_share,
    with_optional,
)
from salesaudit.plans.ordered import cut_off, frequencies, running_sum

ACCOUNT = "internal_account_id"


def _known(sales: DataFrame) -> DataFrame:
    return with_optional(sales, ACCOUNT).where(F.col(ACCOUNT).isNotNull())


def account_totals(sales: DataFrame) -> DataFrame:
    """Counts, sums and dates of each account: what both reports are read from."""
    return with_optional(_known(sales), "transaction_date").groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("total_payment").alias("paid"),
        F.count("total_payment").alias("payments"),
        F.min("transaction_date").alias("first_transaction"),
        F.max("transaction_date").alias("last_transaction"),
    )


def _first_accounts(accounts: DataFrame, top: int | None, shared: bool = True) -> DataFrame:
    """The accounts with the most revenue, in order; those without any sum come first.

    The ``top``-th largest sum is found over bands; only accounts from there on
    are put in order. That needs ``shared`` sums, kept or in one shuffle with
    the rows themselves; to add them up twice costs more than it saves.
    """
    order = [*descending("paid"), *ascending(ACCOUNT)]
    if top is None:
        return accounts.orderBy(*order)
    if not shared:
        return accounts.orderBy(*order).limit(top)
    cut = cut_off(frequencies(accounts, "paid"), top)
    near = F.col("paid").isNull() | (F.col("paid") >= F.col("cut.amount"))
    return attach(accounts, cut=cut).where(near).drop("cut").orderBy(*order).limit(top)


def account_activity(sales: DataFrame, top: int | None = 10_000, accounts: DataFrame | None = None) -> DataFrame:
    """The accounts with the most revenue; ``top=None`` lists all. ``accounts`` are kept :func:`account_totals`."""
    return _first_accounts(accounts or account_totals(sales), top, shared=accounts is not None).select(
        ACCOUNT,
        "transactions",
        as_double(F.col("paid")).alias("revenue"),
        mean(F.col("paid"), F.col("payments")).alias("average_payment"),
        "first_transaction",
        "last_transaction",
    )


def _revenue(sales: DataFrame) -> DataFrame:
    return _known(sales).groupBy(ACCOUNT).agg(F.sum("total_payment").alias("paid"))


def _shares(accounts: DataFrame, total: str) -> DataFrame:
    return accounts.select(
        ACCOUNT,
        as_double(F.col("paid")).alias("revenue"),
        money_share(F.col("paid"), F.col(total)).alias("revenue_percentage"),
        money_share(F.col("so_far"), F.col(total)).alias("cumulative_revenue_percentage"),
    )


def revenue_concentration(sales: DataFrame, top: int | None = 10_000, accounts: DataFrame | None = None) -> DataFrame:
    """Share and cumulative share of the accounts with the most revenue.

    The running sum looks backward only, so it is taken over the ``top``
    accounts alone: its one window task never sees more rows than that. All
    accounts, ``top=None``, go by :func:`revenue_concentration_full`.
    ``accounts`` are kept :func:`account_totals`.
    """
    if top is None:
        return revenue_concentration_full(sales, accounts)
    revenue = accounts.select(ACCOUNT, "paid") if accounts else _revenue(sales)
    order = descending("paid") + ascending(ACCOUNT)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leading = _first_accounts(revenue, top).withColumn("so_far", F.sum("paid").over(so_far))
    leading = attach(leading.orderBy(*order), whole=revenue.agg(F.sum("paid").alias("paid")))
    return _shares(leading, "whole.paid")


def revenue_concentration_full(sales: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The same for every account, in order, by prefix sums over bands of revenue."""
    revenue = accounts.select(ACCOUNT, "paid") if accounts else _revenue(sales)
    order = descending("paid") + ascending(ACCOUNT)
    return _shares(running_sum(revenue, "paid", ACCOUNT, "so_far", "total").orderBy(*order), "total")
