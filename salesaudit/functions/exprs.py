"""Column expressions shared by the operators. Nothing here looks at data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesaudit.sources.schema import NULL_LABEL, SALES


def named(name: str) -> Column:
    """Column of that exact name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate that is a column of ``df``, else None."""
    return next((name for name in candidates if name in df.columns), None)


def existing(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """The candidates that are columns of ``df``, order kept."""
    return [name for name in candidates if name in df.columns]


def with_optional(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or no rows at all if one of the named columns is absent.

    The absent column is added as a typed NULL, so the operator that follows
    still has its fixed output schema; Catalyst folds the plan to an empty one.
    """
    absent = [name for name in names if name not in df.columns]
    if not absent:
        return df
    typed = {name: F.lit(None).cast(SALES[name].dataType) for name in absent}
    return df.withColumns(typed).where(F.lit(False))


def first_rows(df: DataFrame, top: int | None) -> DataFrame:
    """The first ``top`` rows of an ordered frame, None for all."""
    return df if top is None else df.limit(top)


# --- missing values -------------------------------------------------------


def is_blank(column: Column) -> Column:
    """Text of spaces only. A tab is not a space."""
    return F.trim(column) == ""


def is_present(column: Column) -> Column:
    """Text that is neither NULL nor blank."""
    return column.isNotNull() & ~is_blank(column)


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


# --- labels ---------------------------------------------------------------


def null_label(column: Column) -> Column:
    return F.coalesce(column, F.lit(NULL_LABEL))


def flag_label(column: Column, true: str, false: str, null: str) -> Column:
    """Label of a three-valued boolean."""
    return F.when(column.isNull(), null).when(column, true).otherwise(false)


# --- arithmetic -----------------------------------------------------------


def as_double(money: Column) -> Column:
    return money.cast("double")


def mean(total: Column, count: Column) -> Column:
    """Exact decimal total over a count, as a double; NULL over no values."""
    return total.cast("double") / F.nullif(count, F.lit(0)).cast("double")


def _rounded(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` of whole numbers in units of the last digit, rounded
    half away from zero; NULL if ``whole`` is zero.

    Whole-number division is exact. A decimal quotient is cut to the digits
    that fit first, and rounding that again is sometimes off by one.
    """
    size = F.abs(F.nullif(whole, F.lit(0)))
    units = F.call_function("div", F.abs(part) * F.lit(2 * 10**digits) + size, size * F.lit(2))
    return F.when((part < 0) != (whole < 0), -units).otherwise(units)


def _cents(money: Column) -> Column:
    """Money sum as a whole number: 28 digits is what Spark gives the sum of an
    18-digit column."""
    return (money.cast("decimal(28,2)") * F.lit(100)).cast("decimal(28,0)")


def _places(units: Column, digits: int) -> Column:
    return units.cast("double") / F.lit(float(10**digits))


def rounded_mean(total: Column, count: Column, digits: int) -> Column:
    """Mean of money, rounded half up, as a double."""
    return _places(_rounded(_cents(total), _whole(count) * F.lit(100), digits), digits)


def mean_text(total: Column, count: Column, digits: int) -> Column:
    """The rounded mean as text with all its digits."""
    units = _rounded(_cents(total), _whole(count) * F.lit(100), digits)
    return (units.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string")


def _whole(count: Column) -> Column:
    return count.cast("decimal(19,0)")


def count_share(part: Column, whole: Column, digits: int = 4) -> Column:
    """``100 * part / whole`` of two counts, rounded half up."""
    return _places(_rounded(_whole(part), _whole(whole), digits + 2), digits)


def money_share(part: Column, whole: Column, digits: int = 4) -> Column:
    """``100 * part / whole`` of two money sums, rounded half up."""
    return _places(_rounded(_cents(part), _cents(whole), digits + 2), digits)


def raw_share(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` in doubles, unrounded."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * F.lit(100.0)


def to_number(column: Column) -> Column:
    """Numeric coercion: what does not parse becomes NULL."""
    return column.try_cast("double")


# --- display text ---------------------------------------------------------


def money_text(column: Column, null_text: str = "$0.00") -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(column, 2)), F.lit(null_text))


def count_text(column: Column, null_text: str = "0", whole: bool = True) -> Column:
    """Thousands-separated count. ``whole`` truncates, otherwise rounds."""
    value = column.cast("bigint") if whole else column
    return F.coalesce(F.format_number(value, 0), F.lit(null_text))


def percent_text(column: Column, null_text: str = "0.00%") -> Column:
    """Two decimals and a percent sign, without thousands separators."""
    digits = F.replace(F.format_number(column, 2), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(digits, F.lit("%")), F.lit(null_text))


def cell_text(column: Column) -> Column:
    """Text that is safe inside a pipe-separated table."""
    return F.replace(column.cast("string"), F.lit("|"), F.lit("/"))


# --- ordering -------------------------------------------------------------


def descending(*names: str) -> list[Column]:
    """Descending with NULL first, as PostgreSQL sorts."""
    return [F.desc_nulls_first(name) for name in names]


def ascending(*names: str) -> list[Column]:
    """Ascending with NULL last, as PostgreSQL sorts."""
    return [F.asc_nulls_last(name) for name in names]


# --- small frames ---------------------------------------------------------


def attach(df: DataFrame, **one_row: DataFrame) -> DataFrame:
    """Add one-row frames to every row of ``df`` as struct columns.

    Each one becomes a scalar subquery, so nothing is joined and Spark reuses
    the shuffles both sides have in common. A frame with no row gives NULL.
    Every column of such a frame is computed: select the needed ones first.
    """
    structs = [
        frame.select(F.struct(*map(named, frame.columns)).alias("it")).scalar().alias(alias)
        for alias, frame in one_row.items()
    ]
    return df.select("*", *structs)


def lines(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One output row per non-NULL struct, in the given order.

    ``df`` has one row; a rule that does not fire passes NULL.
    """
    numbered = df.select(F.posexplode(F.array(*structs)).alias("position", "line"))
    return numbered.where(F.col("line").isNotNull()).select("position", "line.*")
