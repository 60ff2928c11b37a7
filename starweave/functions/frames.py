"""Small local frames: metadata-sized rows (columns, tables, checks) as a local relation, never data rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A frame of the given rows; the optimizer sees a local relation of known size."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(st)
    columns = list(zip(*rows)) if rows else [()] * len(st.fields)
    arrays = [pa.array([_arrow_value(v, f.dataType) for v in c], a.type) for c, f, a in zip(columns, st.fields, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=st.names), st)


def _arrow_value(v, dt: T.DataType):
    return float(v) if v is not None and isinstance(dt, (T.FloatType, T.DoubleType)) else v
