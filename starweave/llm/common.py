"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, text expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starweave.session import scratch_path

# The white space bytes that separate words, and the letters that lower-casing touches.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BREAK = r"[\x20\x09-\x0D]+"

BROADCAST_LIMIT = 32 << 20
"""Most bytes that any operator here broadcasts; larger sides are joined by a shuffle."""


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (they may not have it on their path)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="starweave-code-"), "starweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("starweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def new_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (one per call, removed with the application's others)."""
    return scratch_path(spark, f"starweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = new_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows at ``row_bytes`` each stay within ``limit``.

    Beyond the limit no hint is set and the join shuffles both sides; the result is the same.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is (``lower`` only where all are ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, \\n, \\v, \\f and \\r, in order; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """Each of ``names`` with underscores put in front until no column of ``taken`` has it (whatever the case)."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out
