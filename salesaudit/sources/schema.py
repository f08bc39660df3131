"""The one table the library audits: its columns, their types and their roles."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Column names and types of the sales table, in table order.
SALES = T.StructType(
    [
        T.StructField("primary_ticket_id", T.StringType()),
        T.StructField("subscription_instance_id", T.StringType()),
        T.StructField("sales_item_id", T.StringType()),
        T.StructField("product_item_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("internal_account_id", T.StringType()),
        T.StructField("sales_rep", T.StringType()),
        T.StructField("transaction_date", T.TimestampNTZType()),
        T.StructField("last_touched_at", T.TimestampType()),
        T.StructField("item_type", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("sale_type", T.StringType()),
        T.StructField("transfer_status", T.StringType()),
        T.StructField("resale_status", T.StringType()),
        T.StructField("sales_details", T.StringType()),
        T.StructField("price_level", T.StringType()),
        T.StructField("price_type", T.StringType()),
        T.StructField("price_type_group", T.StringType()),
        T.StructField("total_payment", MONEY),
        T.StructField("total_plan_amount", MONEY),
        T.StructField("section", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("seat", T.StringType()),
        T.StructField("product_description", T.StringType()),
        T.StructField("application_channel", T.StringType()),
        T.StructField("is_hospitality", T.BooleanType()),
    ]
)

COLUMNS = tuple(SALES.fieldNames())

# Identifiers whose uniqueness is audited, in report order.
IDENTIFIERS = (
    "primary_ticket_id",
    "subscription_instance_id",
    "sales_item_id",
    "product_item_id",
    "transaction_id",
    "product_id",
    "internal_account_id",
)

# The scorecard and the duplicate-group report leave the account id out.
ITEM_IDENTIFIERS = IDENTIFIERS[:-1]

# Fixed value: label that stands for NULL in a breakdown.
NULL_LABEL = "[NULL]"
