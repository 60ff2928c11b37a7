"""Name- and type-based classification rules, as Spark column expressions.

Applied to a column-metadata DataFrame (one row per profiled column), so a whole catalogue of tables
is classified in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values (must equal the behaviour being reproduced):
# a column is an identifier when its lower-cased name ends in "_id", is exactly "id", or contains "guid";
# it is date-like by name when the name contains "date" or "time" anywhere (so "update_count" and
# "lifetime_value" are date-like); a numeric column is a measure when its name contains one of these terms.
ID_PATTERN = r"_id$|^id$|guid"
DATE_NAME_PATTERN = r"date|time"
MEASURE_TERMS = (
    "amount", "price", "cost", "qty", "quantity", "total", "sum",
    "count", "dbu", "usage", "metric", "value", "score", "rate",
)
# Ratio thresholds of distinct values to rows for the entity roles.
NUMERIC_DIMENSION_RATIO = 0.1
STRING_DIMENSION_RATIO = 0.5
# Dimension columns whose name has no "_" share this group name.
DEFAULT_PREFIX = "dimension"


def _lname(name: Column) -> Column:
    return F.lower(name)


def is_id_name(name: Column) -> Column:
    return _lname(name).rlike(ID_PATTERN)


def is_date_name(name: Column) -> Column:
    return _lname(name).rlike(DATE_NAME_PATTERN)


def logical_type_expr(name: Column, physical: Column) -> Column:
    """ID / DATE by name first, then by physical kind (INTEGER, FLOAT, BOOLEAN, DATE), else STRING.

    ``physical`` holds the kind derived from the Spark type (see ``types.logical_type_of``).
    """
    return (
        F.when(is_id_name(name), F.lit("ID"))
        .when(is_date_name(name), F.lit("DATE"))
        .otherwise(physical)
    )


def measure_name_expr(name: Column) -> Column:
    ln = _lname(name)
    cond = F.lit(False)
    for term in MEASURE_TERMS:
        cond = cond | ln.contains(term)
    return cond


def name_prefix_expr(name: Column) -> Column:
    """All '_'-separated tokens but the last; a name without '_' maps to ``DEFAULT_PREFIX``."""
    return F.when(name.contains("_"), F.regexp_replace(name, r"_[^_]*$", "")).otherwise(F.lit(DEFAULT_PREFIX))


def entity_role_expr(name: Column, logical_type: Column, distinct_count: Column, total_rows: Column) -> Column:
    """ids / dates / facts / dimensions, or NULL when the column takes no role."""
    ratio = F.when(total_rows > 0, distinct_count / total_rows).otherwise(F.lit(0.0))
    numeric = logical_type.isin("INTEGER", "FLOAT")
    return (
        F.when(is_id_name(name), F.lit("ids"))
        .when(logical_type == "DATE", F.lit("dates"))
        .when(numeric & measure_name_expr(name), F.lit("facts"))
        .when(numeric & (ratio < NUMERIC_DIMENSION_RATIO), F.lit("dimensions"))
        .when(numeric, F.lit("facts"))
        .when((logical_type == "STRING") & (ratio < STRING_DIMENSION_RATIO), F.lit("dimensions"))
    )


def grain_expr(name: Column) -> Column:
    """Aggregate over one table's column names: transaction / event / row_level."""
    ln = _lname(name)
    has_txn = F.bool_or(ln.contains("transaction") & ln.contains("id"))
    has_date = F.bool_or(ln.contains("date") | ln.contains("time"))
    has_id = F.bool_or(ln.contains("_id") | (ln == "id"))
    return F.when(has_txn, F.lit("transaction")).when(has_date & has_id, F.lit("event")).otherwise(F.lit("row_level"))


# Text date/timestamp layouts tried, in this order, after Spark's ISO parsing (month first
# for ambiguous slashed dates, like the lenient parser being reproduced).
DATE_FORMATS = (
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
    "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)
