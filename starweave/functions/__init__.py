"""Column-expression building blocks (all JVM-side built-ins, no UDFs)."""

from starweave.functions.hashing import canonical_text, hash_columns
from starweave.functions.rules import (
    ID_PATTERN,
    DATE_NAME_PATTERN,
    MEASURE_TERMS,
    logical_type_expr,
    measure_name_expr,
    name_prefix_expr,
)
from starweave.functions.types import logical_type_of, warehouse_type_of
from starweave.functions.calendar import calendar_columns

__all__ = [
    "canonical_text",
    "hash_columns",
    "ID_PATTERN",
    "DATE_NAME_PATTERN",
    "MEASURE_TERMS",
    "logical_type_expr",
    "measure_name_expr",
    "name_prefix_expr",
    "logical_type_of",
    "warehouse_type_of",
    "calendar_columns",
]
