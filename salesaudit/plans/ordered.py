"""Plans for questions about one global order, without one global sort task.

* :func:`percentiles` and :func:`cut_off` find exact amounts at positions of the
  order over bands of a fixed width, so that every window group has a size known
  beforehand.
* :func:`running_sum` gives every row its running total by prefix sums over a
  fixed tree of bands.
* :func:`leading` finds the first rows level by level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesaudit.functions.exprs import attach

# Widths of the bands, widest first, in money units. Two-decimal money has at
# most a million values in a band of 10,000; a wide band has at most a million
# such bands; 18 digits make at most two million wide bands.
BAND_WIDTHS = (10_000_000_000, 10_000)


def _band(value: str, width: int) -> Column:
    """Number of the band, rising with the value.

    It is never NULL, and says so: a join on it then adds no filter to one of
    two equal inputs, which Spark would stop sharing.
    """
    band = F.floor(F.col(value).cast("double") / F.lit(float(width)))
    return F.coalesce(band.cast("bigint"), F.lit(0).cast("bigint"))


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """(amount, rows): how many rows have each amount; NULL has its line too."""
    return df.groupBy(F.col(value).alias("amount")).agg(F.count(F.lit(1)).alias("rows"))


def percentiles(amounts: DataFrame, points: dict[str, float]) -> DataFrame:
    """One row with an exact, linearly interpolated percentile per point.

    ``amounts`` are :func:`frequencies` of two-decimal money; ``points`` maps
    output names to fractions.
    """
    places = {name: F.lit(point) * (F.col("total") - 1) for name, point in points.items()}
    wanted = [end(place).cast("bigint") for place in places.values() for end in (F.floor, F.ceil)]
    found = _at(amounts, wanted)
    return found.select(*(_interpolated(place).alias(name) for name, place in places.items()))


def cut_off(amounts: DataFrame, top: int) -> DataFrame:
    """One row with the ``top``-th largest amount (the smallest if there are fewer), NULL without any."""
    place = F.greatest(F.col("total") - top, F.lit(0).cast("bigint"))
    return _at(amounts, [place]).select(F.try_element_at("amounts", place).alias("amount"))


def _at(amounts: DataFrame, wanted: list[Column]) -> DataFrame:
    """One row: the total of rows with an amount, and a map from wanted positions to amounts.

    Positions count from 0 over all rows in rising order. From the wide bands to
    the narrow ones to the amounts, only the groups that hold a wanted position
    go on: at most one per position, which bounds what is broadcast. The wide
    bands are the one level that is counted in a single task. NULL takes no
    position; it is not filtered out, so that Spark shares the one frequency
    table with whatever else reads it.
    """
    wide, narrow = BAND_WIDTHS
    count = F.sum("rows").alias("rows")
    amounts = amounts.withColumn("rows", F.when(F.col("amount").isNull(), F.lit(0)).otherwise(F.col("rows")))
    bands = amounts.groupBy(_band("amount", narrow).alias("band")).agg(count)
    bands = bands.withColumn("wide", _band("band", wide // narrow))

    wides = bands.groupBy("wide").agg(count).withColumn("base", F.lit(0).cast("bigint"))
    wides = wides.withColumn("total", F.sum("rows").over(Window.partitionBy()))
    wides = wides.withColumn("positions", F.array_distinct(F.array(*wanted)))
    wides = _started(wides, [], "wide").where(F.exists("positions", _held))
    bands = _started(_into(bands, wides, "wide"), ["wide"], "band").where(F.exists("positions", _held))
    amounts = _into(amounts.withColumn("band", _band("amount", narrow)), bands, "band")

    # the one long level: exploding keeps the test in generated code
    found = _started(amounts, ["band"], "amount").withColumn("position", F.explode("positions"))
    found = found.where(_held(F.col("position"))).select("total", F.struct("position", "amount").alias("entry"))
    return found.agg(
        F.max("total").alias("total"), F.map_from_entries(F.collect_list("entry")).alias("amounts")
    )


def _held(position: Column) -> Column:
    """Whether the group's rows take that position."""
    return (position >= F.col("start")) & (position < F.col("start") + F.col("rows"))


def _started(groups: DataFrame, within: list[str], key: str) -> DataFrame:
    """Add ``start``: the position of each group's first row."""
    before = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("start", F.col("base") + F.coalesce(F.sum("rows").over(before), F.lit(0)))


def _into(groups: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The groups inside the few parents that hold a wanted position."""
    parents = parents.select(key, F.col("start").alias("base"), "total", "positions")
    return groups.join(F.broadcast(parents), key)


def _interpolated(place: Column) -> Column:
    low = F.try_element_at("amounts", F.floor(place).cast("bigint")).cast("double")
    high = F.try_element_at("amounts", F.ceil(place).cast("bigint")).cast("double")
    return low + (high - low) * (place - F.floor(place))


# Fixed tree of bands for running sums: wide bands of about 1.6 % of the amount, 4,096 narrow ones in each, and
# inside a narrow band parts of the keys. Amounts of up to 38 digits make fewer than 12,000 wide bands.
WIDE_BANDS, NARROW_BANDS, KEY_PARTS = 64, 4096, 65_536
KEY_BYTES = 6  # that place a key between the lowest and the highest one
MONEY = "decimal(38,2)"


def _narrow(amount: str) -> Column:
    """Number of the narrow band: it never falls as the amount rises. Never NULL, for the reason :func:`_band` gives."""
    cents = F.col(amount).cast("double") * 100
    band = F.floor(F.signum(cents) * F.log1p(F.abs(cents)) * (WIDE_BANDS * NARROW_BANDS))
    return F.coalesce(band.cast("bigint"), F.lit(0).cast("bigint"))


def _bounds(df: DataFrame, amount: str, key: str) -> DataFrame:
    """One row: the total, how many hex digits all keys begin with in common, and the next digits of the lowest
    and highest. It looks at both columns, like the rows themselves, so that Spark computes ``df`` once."""
    ends = df.agg(F.sum(amount).alias("total"), F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select("total", F.hex(F.encode("low", "UTF-8")).alias("low"), F.hex(F.encode("high", "UTF-8")).alias("high"))
    same = F.expr(
        "coalesce(array_position(transform(sequence(1, greatest(1, least(length(low), length(high)))),"
        " i -> substr(low, i, 1) = substr(high, i, 1)), false), 0)"
    )
    # 0: no difference within the shorter one
    skipped = F.when(same == 0, F.least(F.length("low"), F.length("high"))).otherwise(same - 1)
    ends = ends.withColumn("skipped", (skipped - skipped % 2).cast("int"))
    return ends.select("total", "skipped", *(_digits(F.col(name), F.col("skipped")).alias(name) for name in ("low", "high")))


def _digits(text: Column, skipped: Column) -> Column:
    """The hex digits after the skipped ones as a number; it never falls as the text rises."""
    digits = F.rpad(F.substring(text, skipped + 1, F.lit(2 * KEY_BYTES)), 2 * KEY_BYTES, "0")
    return F.conv(digits, 16, 10).cast("double")


def _key_part(key: str) -> Column:
    """Which part of the keys, from ``bounds``; it never falls as the key rises."""
    place = _digits(F.hex(F.encode(key, "UTF-8")), F.col("bounds.skipped")) - F.col("bounds.low")
    span = F.col("bounds.high") - F.col("bounds.low") + 1
    return F.coalesce(F.floor(place / span * KEY_PARTS).cast("int"), F.lit(0))


def running_sum(df: DataFrame, amount: str, key: str, output: str, total: str) -> DataFrame:
    """Add the running sum of ``amount``, largest first and equal amounts by ``key``, and its total.

    ``key`` is a text that no two rows share. Prefix sums go down a fixed tree:
    wide bands, narrow bands, (amount, part of the keys) within a narrow band.
    No range is sampled, so recomputing a task gives the same; nothing runs
    while the plan is declared. Each row then adds its place among the rows of
    its own (amount, part): even where most rows have one amount, those are
    dealt to as many tasks as the keys have parts. Windows see the wide bands
    (their number is bounded whatever the data), the narrow bands of a wide one,
    and the parts of a narrow one. Rows without an amount have no sum.
    """
    rows = attach(df.withColumn("narrow", _narrow(amount)), bounds=_bounds(df, amount, key))
    rows = rows.withColumn("part", _key_part(key)).withColumn(total, F.col("bounds.total")).drop("bounds")
    parts = rows.groupBy("narrow", amount, "part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.where(F.col(amount).isNotNull())
    parts = parts.withColumn("sum", (F.col("rows").cast("decimal(18,0)") * F.col(amount)).cast(MONEY))

    narrows = parts.groupBy("narrow").agg(F.sum("sum").cast(MONEY).alias("sum"))
    wide = F.coalesce(F.floor(F.col("narrow") / NARROW_BANDS).cast("bigint"), F.lit(0).cast("bigint"))
    narrows = narrows.withColumn("wide", wide)
    wides = narrows.groupBy("wide").agg(F.sum("sum").cast(MONEY).alias("sum"))
    wides = wides.select("wide", _before([], F.desc("wide")).alias("wide_start"))
    narrows = narrows.join(F.broadcast(wides), "wide")
    narrows = narrows.select("narrow", (F.col("wide_start") + _before(["wide"], F.desc("narrow"))).cast(MONEY).alias("start"))
    inside = _before(["narrow"], F.desc(amount), F.asc("part"))
    parts = parts.withColumn("before", inside).join(narrows, "narrow")
    parts = parts.select("narrow", amount, "part", (F.col("start") + F.col("before")).cast(MONEY).alias("start"))

    placed = rows.join(parts, ["narrow", amount, "part"], "left")
    place = F.row_number().over(Window.partitionBy("narrow", amount, "part").orderBy(key))
    so_far = (F.col("start") + (place.cast("decimal(18,0)") * F.col(amount)).cast(MONEY)).cast(MONEY)
    return placed.withColumn(output, so_far).drop("narrow", "part", "start")


def _before(within: list[str], *order: Column) -> Column:
    """The sum of the groups before, 0 for the first."""
    window = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("sum").over(window), F.lit(0)).cast(MONEY)


# Up to this many rows Spark keeps only the first rows of a group in each task before it shuffles them.
GROUP_LIMIT = 1000
LEVELS = (4096, 64)


def leading(df: DataFrame, order: Sequence[Column], top: int) -> DataFrame:
    """The first ``top`` rows, merged level by level.

    Each task keeps its first rows, then groups of tasks, then groups of those:
    the last task sees 64 x ``top`` rows however many tasks there are. More
    than 1,000 rows go to it from each task at once.
    """
    if top <= GROUP_LIMIT:
        for groups in LEVELS:
            df = df.withColumn("__group", F.spark_partition_id() % groups)
            place = F.row_number().over(Window.partitionBy("__group").orderBy(*order))
            df = df.withColumn("__place", place).where(F.col("__place") <= top).drop("__group", "__place")
    return df.orderBy(*order).limit(top)
