"""Calendar attributes of a date (date dimension)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def calendar_columns(d: Column) -> list[Column]:
    """YEAR, QUARTER, MONTH, DAY, DAY_OF_WEEK (1 = Monday .. 7 = Sunday), DAY_NAME, MONTH_NAME, IS_WEEKEND."""
    return [
        F.year(d).alias("YEAR"),
        F.quarter(d).alias("QUARTER"),
        F.month(d).alias("MONTH"),
        F.dayofmonth(d).alias("DAY"),
        (F.weekday(d) + 1).alias("DAY_OF_WEEK"),
        F.date_format(d, "EEEE").alias("DAY_NAME"),
        F.date_format(d, "MMMM").alias("MONTH_NAME"),
        (F.weekday(d) >= 5).alias("IS_WEEKEND"),
    ]
