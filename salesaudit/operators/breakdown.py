"""Records and revenue by one dimension.

:func:`breakdown` is the general form; the named reports below fix its
parameters. Groups are combined before the shuffle, so a value that holds a
large part of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.functions.exprs import (
    as_double,
    ascending,
    attach,
    count_share,
    descending,
    existing,
    flag_label,
    is_present,
    mean,
    money_share,
    null_label,
    rounded_mean,
    with_optional,
)
from salesaudit.operators.missing import STRUCTURAL
from salesaudit.sources.schema import SALES


def breakdown(
    sales: DataFrame,
    dimension: str,
    *,
    key: Column | None = None,
    name: str | None = None,
    label: str = "before",
    count: str = "records",
    revenue: str = "revenue",
    shares: tuple[str, ...] = (),
    share_digits: int = 4,
    digits: int | None = None,
    average: bool = True,
    extras: dict[str, Column] | None = None,
    bounds: bool = False,
    order: str = "revenue",
    top: int | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Group ``sales`` by one dimension.

    key           expression to group by, default the dimension column
    name          output name of the key
    label         "before": NULL becomes a label, then rows are grouped;
                  "after": rows are grouped, then the NULL group is labelled;
                  "no": the NULL group stays NULL.
                  The first two differ if the label occurs as a value
    shares        any of "records", "revenue": percentage of the whole
    digits        round revenue and average half up, default unrounded
    extras        further aggregates, by output name
    bounds        add the lowest and highest payment
    order         "revenue" or "records" descending, "key" ascending
    top           keep this many groups, default all
    profile       a kept :func:`dimension_profile`: its groups are read in place of
                  the table; ``extras`` then see its columns

    A table without the dimension column gives no rows. Equal places are
    ordered by the key.
    """
    name = name or dimension
    key = F.col(dimension) if key is None else key
    extras = extras or {}
    if bounds:
        low, high = ("lowest", "highest") if profile is not None else ("total_payment", "total_payment")
        extras = extras | {
            "minimum_payment": as_double(F.min(low)),
            "maximum_payment": as_double(F.max(high)),
        }
    if profile is None:
        rows, counts = with_optional(sales, dimension), _COUNTS
    else:
        rows, counts = _profiled(profile, dimension), _SUMMED
    groups = rows.groupBy((null_label(key) if label == "before" else key).alias(name)).agg(
        *(counted(column).alias(column) for column, counted in counts.items()),
        *(aggregate.alias(extra) for extra, aggregate in extras.items()),
    )
    if label == "after":
        groups = groups.withColumn(name, null_label(F.col(name)))
    if shares:
        groups = attach(groups, whole=_whole(groups, name))

    by_key = ascending(name)
    places = {"revenue": descending("paid") + by_key, "records": descending("rows") + by_key, "key": by_key}
    groups = groups.orderBy(*places[order])
    if top is not None:
        groups = groups.limit(top)

    paid = F.col("paid") if digits is None else F.round("paid", digits)
    columns = [F.col(name), F.col("rows").alias(count)]
    if "records" in shares:
        columns.append(count_share(F.col("rows"), F.col("whole.rows"), share_digits).alias("record_percentage"))
    columns.append(as_double(paid).alias(revenue))
    if "revenue" in shares:
        columns.append(money_share(F.col("paid"), F.col("whole.paid"), share_digits).alias("revenue_percentage"))
    if average and digits is None:
        columns.append(mean(F.col("paid"), F.col("payments")).alias("average_payment"))
    elif average:
        columns.append(rounded_mean(F.col("paid"), F.col("payments"), digits).alias("average_payment"))
    return groups.select(*columns, *extras)


def _whole(groups: DataFrame, name: str) -> DataFrame:
    """Totals over all groups. The columns without a total are looked at too:
    the groups are then the same aggregate in both places, and Spark computes
    them once."""
    rest = [column for column in groups.columns if column not in (name, "rows", "paid")]
    return groups.agg(F.sum("rows").alias("rows"), F.sum("paid").alias("paid"), *map(F.max, rest))


# Counts of a group from rows of the table, and from rows of a profile.
_COUNTS = {
    "rows": lambda _: F.count(F.lit(1)),
    "paid": lambda _: F.sum("total_payment"),
    "payments": lambda _: F.count("total_payment"),
}
_SUMMED = {name: F.sum for name in _COUNTS}


# --- one pass for many dimensions ------------------------------------------

# Dimensions whose reports read one profile.
PROFILED = (
    "product_type",
    "sale_type",
    "application_channel",
    "is_hospitality",
    "price_level",
    "price_type",
    "transfer_status",
    "resale_status",
    "product_description",
)


def dimension_profile(sales: DataFrame, dimensions: tuple[str, ...] = PROFILED) -> DataFrame:
    """Per (dimension, value): counts, sums and bounds of payments, and NULLs of the structural fields per product type.

    One pass and one shuffle for all the dimensions that the table has. Rows
    are combined per value in each task first, so that a value that most rows
    have is one row per task. Values are kept as text.
    """
    names = existing(sales, dimensions)
    fields = existing(sales, STRUCTURAL) if "product_type" in names else []
    values = F.array(*(F.col(name).cast("string") for name in names))
    tagged = sales.select("total_payment", *fields, F.posexplode(values).alias("position", "value"))
    of_product = F.col("position") == (names.index("product_type") if "product_type" in names else -1)
    groups = tagged.groupBy("position", "value").agg(
        *(counted(column).alias(column) for column, counted in _COUNTS.items()),
        F.min("total_payment").alias("lowest"),
        F.max("total_payment").alias("highest"),
        *(F.count_if(of_product & F.col(name).isNull()).alias(f"null {name}") for name in fields),
    )
    label = F.element_at(F.array(*map(F.lit, names)), F.col("position") + 1) if names else F.lit(None).cast("string")
    return groups.withColumn("dimension", label).drop("position")


def _profiled(profile: DataFrame, dimension: str) -> DataFrame:
    own = profile.where(F.col("dimension") == dimension)
    return own.withColumn(dimension, F.col("value").cast(SALES[dimension].dataType))


# --- current audit --------------------------------------------------------

BOTH = ("records", "revenue")


def product_type_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "product_type", label="after", shares=BOTH, bounds=True, profile=profile)


def sale_type_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "sale_type", label="after", shares=BOTH, profile=profile)


def application_channel_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "application_channel", label="after", shares=BOTH, profile=profile)


def hospitality_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    status = flag_label(F.col("is_hospitality"), "Hospitality", "Non-Hospitality", "[NULL]")
    return breakdown(sales, "is_hospitality", key=status, name="hospitality_status", profile=profile)


def price_level_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "price_level", profile=profile)


def price_type_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "price_type", profile=profile)


def sales_rep_performance(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The distinct accounts are counted per (rep, account) first, so the rows
    without a rep, most of the table, spread over all tasks. ``profile`` is a
    kept :func:`distinct_profile` over ``sales_rep``."""
    if profile is not None:
        return breakdown(sales, "sales_rep", extras={"accounts": F.sum("different")}, profile=profile)
    return breakdown(sales, "sales_rep", extras={"accounts": F.countDistinct("internal_account_id")})


def distinct_profile(sales: DataFrame, groups: dict[str, tuple[Column, str]]) -> DataFrame:
    """Per (dimension, value): counts, sums, and how many ``different`` values of another column.

    ``groups``: name of the dimension -> expression of the group, column whose
    different values are counted. All share one pass and one shuffle of
    (dimension, group, value), in which a hot group is spread by its values.
    """
    tags = F.array(
        *(
            F.struct(F.lit(name).alias("dimension"), key.cast("string").alias("value"), F.col(column).cast("string").alias("item"))
            for name, (key, column) in groups.items()
        )
    )
    tagged = sales.select("total_payment", F.inline(tags))
    items = tagged.groupBy("dimension", "value", "item").agg(
        *(counted(column).alias(column) for column, counted in _COUNTS.items())
    )
    return items.groupBy("dimension", "value").agg(
        *(F.sum(column).alias(column) for column in _COUNTS), F.count("item").alias("different")
    )


def transfer_status(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "transfer_status", order="records", profile=profile)


def resale_status(sales: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    return breakdown(sales, "resale_status", order="records", profile=profile)


def product_description_performance(
    sales: DataFrame, top: int = 500, profile: DataFrame | None = None
) -> DataFrame:
    return breakdown(sales, "product_description", top=top, profile=profile)


# --- earlier audit --------------------------------------------------------


def _basic(sales: DataFrame, dimension: str) -> DataFrame:
    return breakdown(
        sales, dimension, label="after", shares=("records",), share_digits=2, digits=2, order="records"
    )


def product_type_basic(sales: DataFrame) -> DataFrame:
    return _basic(sales, "product_type")


def sale_type_basic(sales: DataFrame) -> DataFrame:
    return _basic(sales, "sale_type")


def application_channel_basic(sales: DataFrame) -> DataFrame:
    return _basic(sales, "application_channel")


def hospitality_basic(sales: DataFrame) -> DataFrame:
    status = flag_label(F.col("is_hospitality"), "true", "false", "NULL")
    return breakdown(
        sales, "is_hospitality", key=status, name="hospitality_status", digits=2, order="records"
    )


def top_product_descriptions(sales: DataFrame, top: int = 100, digits: int | None = 2) -> DataFrame:
    named = with_optional(sales, "product_description").where(is_present(F.col("product_description")))
    return breakdown(named, "product_description", digits=digits, order="records", top=top)


def transfer_status_basic(sales: DataFrame) -> DataFrame:
    return breakdown(sales, "transfer_status", label="after", digits=2, average=False, order="records")


def resale_status_basic(sales: DataFrame) -> DataFrame:
    return breakdown(sales, "resale_status", label="after", digits=2, average=False, order="records")


# --- notebook -------------------------------------------------------------


def _summary(sales: DataFrame, dimension: str, **parameters) -> DataFrame:
    return breakdown(sales, dimension, label="no", count="transactions", **parameters)


def product_summary(sales: DataFrame) -> DataFrame:
    return _summary(sales, "product_type", bounds=True)


def channel_summary(sales: DataFrame) -> DataFrame:
    return _summary(sales, "application_channel")


def sale_type_summary(sales: DataFrame) -> DataFrame:
    return _summary(sales, "sale_type")


def hospitality_summary(sales: DataFrame) -> DataFrame:
    return _summary(sales, "is_hospitality", order="key")


def top_price_levels(sales: DataFrame, top: int = 25) -> DataFrame:
    return _summary(sales, "price_level", top=top)


def top_price_types(sales: DataFrame, top: int = 25) -> DataFrame:
    return _summary(sales, "price_type", top=top)


def top_sales_reps(sales: DataFrame, top: int = 20) -> DataFrame:
    return _summary(sales, "sales_rep", top=top)


# --- best groups ----------------------------------------------------------


def top_groups(
    sales: DataFrame, dimensions: tuple[str, ...] = ("product_type", "application_channel")
) -> DataFrame:
    """The group with the highest revenue of each dimension, from one pass.

    Groups without any payment only win if there is no other; equal groups are
    ordered by name.
    """
    pairs = sales.select("total_payment", *dimensions).unpivot(
        ["total_payment"], list(dimensions), "dimension", "group"
    )
    groups = pairs.groupBy("dimension", "group").agg(F.sum("total_payment").alias("paid"))
    place = F.struct(F.col("paid").isNull(), -F.col("paid"), F.col("group").isNull(), F.col("group"))
    best = groups.groupBy("dimension").agg(F.min_by(F.struct("group", "paid"), place).alias("best"))
    return best.select(
        "dimension",
        F.col("best.group").alias("top_group"),
        as_double(F.col("best.paid")).alias("revenue"),
    ).orderBy(F.array_position(F.array(*map(F.lit, dimensions)), F.col("dimension")))
