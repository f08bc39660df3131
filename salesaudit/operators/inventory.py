"""Column inventory. It reads the schema, never the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Standard names of the column types.
TYPE_NAMES = {
    T.StringType: "text",
    T.TimestampNTZType: "timestamp without time zone",
    T.TimestampType: "timestamp with time zone",
    T.DecimalType: "numeric",
    T.BooleanType: "boolean",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.DateType: "date",
}

INVENTORY = (
    "ordinal_position int, column_name string, data_type string, is_nullable string, "
    "character_maximum_length int, numeric_precision int, numeric_scale int"
)


def type_name(data_type: T.DataType) -> str:
    return TYPE_NAMES.get(type(data_type), data_type.simpleString())


def column_inventory(sales: DataFrame) -> DataFrame:
    """One line per column, in table order."""
    rows = [
        (
            position,
            field.name,
            type_name(field.dataType),
            "YES" if field.nullable else "NO",
            getattr(field.dataType, "length", None),
            getattr(field.dataType, "precision", None),
            getattr(field.dataType, "scale", None),
        )
        for position, field in enumerate(sales.schema.fields, start=1)
    ]
    return sales.sparkSession.createDataFrame(rows, INVENTORY).orderBy("ordinal_position")


def column_types(sales: DataFrame) -> DataFrame:
    return column_inventory(sales).select("ordinal_position", "column_name", "data_type", "is_nullable")


def column_schema(sales: DataFrame) -> DataFrame:
    return column_inventory(sales).select("column_name", "data_type", "is_nullable")
