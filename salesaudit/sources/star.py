"""The sales table as a view over a star schema (lineitem, orders, part).

``l_orderkey`` and ``l_partkey`` are foreign keys: each line has exactly one
order and one part (``tests/test_star.py`` checks that on the data). So a
dimension whose columns nobody asked for changes no row, and is not joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from salesaudit.sources.schema import COLUMNS

# Each sales column as an SQL expression both engines read.
EXPRESSIONS = {
    "primary_ticket_id": "CASE WHEN l_returnflag <> 'R' THEN CAST(l_orderkey*10+l_linenumber AS VARCHAR(40)) END",
    "subscription_instance_id": "CASE WHEN l_returnflag = 'R' OR l_quantity <= 25 THEN concat('S', CAST(o_custkey AS VARCHAR(40))) END",
    "sales_item_id": "CASE WHEN l_linenumber = 4 AND l_suppkey % 13 = 0 THEN NULL WHEN l_linenumber = 4 AND l_suppkey % 13 = 1 THEN ' ' WHEN l_linenumber >= 6 THEN concat(CAST(l_orderkey AS VARCHAR(40)), '-6') ELSE concat(CAST(l_orderkey AS VARCHAR(40)), '-', CAST(l_linenumber AS VARCHAR(40)), '-', CAST(l_partkey AS VARCHAR(40)), '-', CAST(l_suppkey AS VARCHAR(40))) END",
    "product_item_id": "concat(CAST(l_orderkey AS VARCHAR(40)), '-', CAST(l_linenumber AS VARCHAR(40)), '-', CAST(l_partkey AS VARCHAR(40)), '-', CAST(l_suppkey AS VARCHAR(40)))",
    "transaction_id": "CASE WHEN l_orderkey % 401 = 0 THEN NULL WHEN l_orderkey % 401 = 1 THEN '  ' ELSE CAST(l_orderkey AS VARCHAR(40)) END",
    "product_id": "CASE WHEN l_partkey % 307 <> 0 THEN CAST(l_partkey AS VARCHAR(40)) END",
    "internal_account_id": "CASE WHEN l_suppkey % 50 <> 0 THEN CAST(o_custkey AS VARCHAR(40)) END",
    "sales_rep": "CASE WHEN l_linenumber = 7 THEN CAST(l_suppkey AS VARCHAR(40)) END",
    "transaction_date": "CASE WHEN l_orderkey % 97 <> 0 THEN o_orderdate END",
    "last_touched_at": "CASE WHEN l_suppkey % 89 <> 0 THEN l_shipdate END",
    "item_type": "CASE WHEN l_returnflag = 'R' THEN 'Plan' ELSE 'Seat' END",
    "product_type": "CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 83 = 1 THEN ' ' WHEN l_returnflag = 'A' THEN 'Ticket' WHEN l_returnflag = 'N' THEN 'Resale' ELSE 'Subscription' END",
    "sale_type": "CASE WHEN l_partkey % 79 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'Sale' ELSE 'Reservation Confirmation' END",
    "transfer_status": "CASE l_linenumber WHEN 1 THEN 'Transferred' WHEN 2 THEN 'Pending' WHEN 3 THEN 'Canceled' END",
    "resale_status": "CASE WHEN l_returnflag = 'N' AND l_linenumber <= 2 THEN 'Resold' WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN 'Posted' END",
    "sales_details": "CASE WHEN l_quantity = 50 THEN 'note' WHEN l_quantity = 49 THEN '  ' END",
    "price_level": "CASE WHEN l_partkey % 500 <> 0 THEN o_orderpriority END",
    "price_type": "p_brand",
    "price_type_group": "NULLIF(p_type, 'ECONOMY')",
    "total_payment": "CASE WHEN l_suppkey % 61 = 0 THEN NULL WHEN l_discount < 0.04 THEN CAST(0 AS DECIMAL(18,2)) WHEN l_suppkey % 61 = 1 THEN CAST(-l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END",
    "total_plan_amount": "CAST(o_totalprice AS DECIMAL(18,2))",
    "section": "CASE WHEN l_suppkey % 33 <> 0 THEN concat('S', CAST(l_suppkey % 50 AS VARCHAR(40))) END",
    "row": "CASE WHEN l_suppkey % 33 <> 0 THEN CASE WHEN l_quantity = 1 THEN 'GA1' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(40)) END END",
    "seat": "CASE WHEN l_suppkey % 33 <> 0 THEN CAST(l_linenumber AS VARCHAR(40)) END",
    "product_description": "CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 53 = 1 THEN '   ' ELSE p_name END",
    "application_channel": "CASE WHEN l_suppkey % 47 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Internal' WHEN o_orderstatus = 'O' THEN 'eSRO' ELSE 'bSRO' END",
    "is_hospitality": "CASE WHEN l_returnflag <> 'N' THEN p_size > 45 END",
}

# dimension table -> (line key, dimension key, prefix of its columns)
DIMENSIONS = {
    "orders": ("l_orderkey", "o_orderkey", "o"),
    "part": ("l_partkey", "p_partkey", "p"),
}


def star_sales(spark: SparkSession, folder: str, columns: Iterable[str] = COLUMNS) -> DataFrame:
    """The given sales columns, lazily, from the star tables in ``folder``.

    Join sides are left to Spark: a small dimension is broadcast by its size on
    disk, a large one is sort-merged and split on hot keys at run time.
    """
    wanted = {name: EXPRESSIONS[name] for name in COLUMNS if name in set(columns)}
    text = " ".join(wanted.values())
    sales = spark.read.parquet(f"{folder}/lineitem.parquet")
    for table, (line_key, key, prefix) in DIMENSIONS.items():
        if re.search(rf"\b{prefix}_", text):
            dimension = spark.read.parquet(f"{folder}/{table}.parquet")
            sales = sales.join(dimension, sales[line_key] == dimension[key])
    return sales.selectExpr(*(f"{expression} AS `{name}`" for name, expression in wanted.items()))


def star_sql() -> str:
    """The whole view as a CTE named ``sales``, to put before a query."""
    columns = ",\n  ".join(f'{expression} AS "{name}"' for name, expression in EXPRESSIONS.items())
    joins = " ".join(f"JOIN {table} ON {line} = {key}" for table, (line, key, _) in DIMENSIONS.items())
    return f"WITH sales AS (\n  SELECT {columns}\n  FROM lineitem {joins}\n)\n"
