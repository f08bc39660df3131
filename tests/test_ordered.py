"""Running sums, cut-offs and first rows against plain Python."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesaudit.plans.ordered import cut_off, frequencies, leading, running_sum


def _amounts(kind: str, rng: random.Random) -> list[tuple[str, Decimal | None]]:
    cents = {
        "most at zero": lambda i: 0 if i % 5 else rng.randrange(-500, 100_000),
        "most equal": lambda i: 5_000 if i % 7 else rng.randrange(10_000),
        "spread": lambda i: rng.choice([1, -1]) * 10 ** rng.randrange(1, 24) + rng.randrange(1000),
        "all different": lambda i: i * 37,
    }[kind]
    keys = {
        "most at zero": lambda i: f"{i * 7919 % 100_003}",
        "most equal": lambda i: f"ACCOUNT-OF-THE-CLUB-{i:08d}",
        "spread": lambda i: "é" * (i % 3) + f"k{i}",
        "all different": lambda i: f"{i:05d}" + "x" * (i % 4),
    }[kind]
    rows = [(keys(i), Decimal(cents(i)).scaleb(-2)) for i in range(600)]
    return rows + [("", Decimal("3.00")), ("no sum", None), ("none either", None)]


@pytest.mark.parametrize("kind", ["most at zero", "most equal", "spread", "all different"])
def test_running_sum_in_a_global_order(spark, kind):
    rows = _amounts(kind, random.Random(kind))
    frame = spark.createDataFrame(rows, "key string, paid decimal(28,2)").repartition(7)
    found = {row["key"]: row for row in running_sum(frame, "paid", "key", "so_far", "total").collect()}
    assert len(found) == len(rows)
    so_far = Decimal(0)
    for key, paid in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0].encode())):
        so_far += paid
        assert found[key]["so_far"] == so_far
    assert found["no sum"]["so_far"] is None and found["no sum"]["total"] == so_far


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", Decimal("1.00"))], [("", Decimal("-1.00")), ("b", Decimal("-1.00"))]])
def test_running_sum_of_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "key string, paid decimal(28,2)")
    found = running_sum(frame, "paid", "key", "so_far", "total").orderBy("key").collect()
    paid = [amount for _, amount in rows if amount is not None]
    assert len(found) == len(rows)
    assert [row["so_far"] for row in found] == [sum(paid[: i + 1]) if paid else None for i in range(len(rows))]
    assert all(row["total"] == (sum(paid) if paid else None) for row in found)


def test_one_hot_amount_is_dealt_to_many_tasks(spark):
    """Most rows have one amount: parts of the keys, not the amount, decide where they go."""
    from salesaudit.plans import ordered

    frame = spark.range(20_000).select(F.format_string("C-%09d", "id").alias("key"), F.lit(0).cast("decimal(28,2)").alias("paid"))
    bounds = ordered._bounds(frame, "paid", "key")
    parts = ordered.attach(frame, bounds=bounds).groupBy(ordered._key_part("key").alias("part")).count()
    sizes = [row["count"] for row in parts.collect()]
    assert len(sizes) > 100 and max(sizes) < 2_000


@pytest.mark.parametrize("top", [1, 3, 7, 100])
def test_cut_off(spark, top):
    values = [Decimal(x) for x in ("5.00", "5.00", "-1.00", "0.00", "99999999999.25", "7.10", "5.00")]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "paid decimal(18,2)")
    expected = sorted(values, reverse=True)[min(top, len(values)) - 1]
    assert cut_off(frequencies(frame, "paid"), top).first()["amount"] == expected
    assert cut_off(frequencies(frame.where("paid IS NULL"), "paid"), top).first()["amount"] is None


@pytest.mark.parametrize("top", [0, 1, 40, 1500])
def test_leading_rows(spark, top):
    rng = random.Random(top)
    rows = [(rng.randrange(50), i) for i in range(2_000)] + [(None, 5_000)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(9)
    found = leading(frame, [F.desc_nulls_first("a"), F.asc("b")], top).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))[:top]
    assert [tuple(row) for row in found] == expected
