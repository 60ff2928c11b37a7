"""Writing split tables (one directory per table) and the split summary."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from starweave.functions.frames import local_frame
from starweave.session import HASH_TEXT

SUMMARY_SCHEMA = "table_name string, path string, row_count long, size_bytes long, error string"


def table_path(out_dir: str, table_name: str) -> str:
    return os.path.join(out_dir, table_name.lower())


def write_tables(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    out_dir: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: dict[str, list[str]] | None = None,
    sort_within: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Write every table to ``out_dir/<lower-case name>``; a failing table does not stop the others.

    Row counts come from an ``Observation`` on the write itself (no second pass); sizes from a listing
    of the written files (contents are not read). ``partition_by`` / ``sort_within`` lay a table out by
    columns (e.g. the natural key of a dimension, or ``model.recommend_clustering`` for the fact): a local
    sort per task, no shuffle. Returns the split summary frame.
    """
    rows = []
    for name, df in tables.items():
        path = table_path(out_dir, name)
        obs = Observation(f"rows_{name}")
        try:
            if sort_within and name in sort_within:
                df = df.sortWithinPartitions(*sort_within[name])
            if fmt == "csv":  # temporal values as their exact canonical text (the CSV writer's default is lossy)
                df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name)
                                 if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                                 else F.col(f"`{f.name}`") for f in df.schema.fields])
            writer = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).format(fmt)
            if fmt == "csv":
                writer = writer.option("header", True).option("escape", '"')
            if fmt == "parquet":
                writer = writer.options(**HASH_TEXT)
            if partition_by and name in partition_by:
                writer = writer.partitionBy(*partition_by[name])
            writer.save(path)
            n = obs.get.get("n", 0)
            size = _size(spark, path)
            rows.append((name, path, int(n), size, None))
        except Exception as exc:  # noqa: BLE001 - recorded per table
            rows.append((name, path, None, None, f"Error creating {name}: {exc}"))
    return local_frame(spark, rows, SUMMARY_SCHEMA)


def _size(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("s")).first()
    return int(row["s"])


def split_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("error").isNull()).alias("tables_written"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / (1024 * 1024), 2).alias("total_mb"),
    )


def clustering_layout(recommendation: DataFrame) -> dict[str, list[str]]:
    """``{table: [columns]}`` from ``model.recommend_clustering`` (metadata-sized), for ``sort_within``."""
    out: dict[str, list[tuple[int, str]]] = {}
    for r in recommendation.select("table_name", "cluster_rank", "column_name").collect():
        out.setdefault(r["table_name"], []).append((r["cluster_rank"], r["column_name"]))
    return {t: [c for _, c in sorted(v)] for t, v in out.items()}
