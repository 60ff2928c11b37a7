"""Spark type -> logical kind and -> warehouse type name."""

from __future__ import annotations

from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def logical_type_of(dt: T.DataType) -> str:
    """Kind by type alone (the name rules in ``rules.logical_type_expr`` take precedence)."""
    if isinstance(dt, T.DecimalType):
        return "INTEGER" if dt.scale == 0 else "FLOAT"
    if isinstance(dt, _INTEGRAL):
        return "INTEGER"
    if isinstance(dt, _FRACTIONAL):
        return "FLOAT"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, _TEMPORAL):
        return "DATE"
    return "STRING"


# Warehouse type names of the model's physical layer.
def warehouse_type_of(dt: T.DataType) -> str:
    kind = logical_type_of(dt)
    return {
        "INTEGER": "NUMBER(38,0)",
        "FLOAT": "FLOAT",
        "BOOLEAN": "BOOLEAN",
        "DATE": "TIMESTAMP_NTZ",
    }.get(kind, "TEXT")


_WAREHOUSE_TO_SPARK = {
    "NUMBER(38,0)": T.DecimalType(38, 0),
    "FLOAT": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "TEXT": T.StringType(),
}


def spark_type_of(warehouse_type: str) -> T.DataType:
    return _WAREHOUSE_TO_SPARK.get(warehouse_type, T.StringType())
