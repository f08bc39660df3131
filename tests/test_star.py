from __future__ import annotations

import pytest
from places import DATA
from pyspark.sql import functions as F

from salesaudit.sources.schema import COLUMNS, SALES
from salesaudit.sources.star import DIMENSIONS, star_sales


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_lines_have_exactly_one_row_in_each_dimension(spark, scale):
    """What makes it right not to join a dimension nobody asked for."""
    lines = spark.read.parquet(f"{DATA}/{scale}/lineitem.parquet")
    for table, (line_key, key, _) in DIMENSIONS.items():
        dimension = spark.read.parquet(f"{DATA}/{scale}/{table}.parquet")
        assert lines.join(dimension, lines[line_key] == dimension[key], "left_anti").count() == 0
        assert dimension.groupBy(key).count().where("count > 1").count() == 0


def test_columns_and_types(spark):
    sales = star_sales(spark, f"{DATA}/sf0.001")
    assert tuple(sales.columns) == COLUMNS
    for field in sales.schema.fields:
        if field.name != "last_touched_at":  # zone-less in the star tables
            assert field.dataType == SALES[field.name].dataType, field.name


def test_only_needed_dimensions_are_joined(spark, plan_text):
    folder = f"{DATA}/sf0.001"
    assert "Join" not in plan_text(star_sales(spark, folder, ["product_type", "total_payment"]))
    assert plan_text(star_sales(spark, folder, ["price_type"])).count("Join") == 1
    assert plan_text(star_sales(spark, folder)).count("Join") == 2


def test_pruned_view_has_the_same_rows(spark):
    folder = f"{DATA}/sf0.001"
    names = ["product_type", "total_payment"]
    whole = star_sales(spark, folder).select(*names)
    assert star_sales(spark, folder, names).exceptAll(whole).count() == 0
    assert star_sales(spark, folder, names).count() == whole.count()


def test_known_answers(spark):
    sales = star_sales(spark, f"{DATA}/sf0.01")
    row = sales.agg(F.count(F.lit(1)), F.sum("total_payment"), F.count_if(F.col("sales_rep").isNull())).first()
    assert (row[0], float(row[1]), row[2]) == (60000, 1947189236.89, 51402)


def test_the_view_holds_every_case_the_reports_tell_apart(spark):
    """Each of them occurs, so that a report that gets it wrong differs from its SQL."""
    sales = star_sales(spark, f"{DATA}/sf0.01")
    blank = lambda name: F.count_if(F.trim(name) == "").alias(f"blank {name}")
    null = lambda name: F.count_if(F.col(name).isNull()).alias(f"null {name}")
    nulls = [name for name in COLUMNS if name not in ("item_type", "price_type", "product_item_id", "total_plan_amount")]
    cases = sales.agg(
        *map(null, nulls),
        *map(blank, ("transaction_id", "sales_item_id", "product_type", "product_description", "sales_details")),
        F.count_if(F.col("total_payment") < 0).alias("negative"),
        F.count_if(F.col("total_payment") == 0).alias("zero"),
        F.count_if(F.col("total_payment") > 50_000).alias("over 50,000"),
    ).first()
    assert {name for name, count in cases.asDict().items() if count == 0} == set()
    repeated = sales.groupBy("sales_item_id").count().where("trim(sales_item_id) <> '' AND count > 1")
    assert repeated.count() > 1_000
