"""Audit tables for load runs, per-table load status and rejected rows.

The tables are append-only: a run's state changes are new event rows, and the current state is the
latest event per ``RUN_ID`` (``max_by`` over ``EVENT_SEQ``). Identifiers are ``max + 1`` (runs) or
``max + position`` (status rows), which assumes one writer per audit database at a time.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from starweave.functions.frames import local_frame

# Audit table names and run / table statuses.
RUNS = "INGESTION_RUNS"
STATUS = "INGESTION_TABLE_STATUS"
ERRORS = "INGESTION_ERRORS"
COMMITS = "INGESTION_COMMITS"
IN_PROGRESS = "IN_PROGRESS"
SUCCESS = "SUCCESS"
PARTIAL = "PARTIAL"
FAILED = "FAILED"

RUNS_SCHEMA = (
    "RUN_ID long, EVENT_SEQ long, RUN_START_TS timestamp_ntz, RUN_END_TS timestamp_ntz, STATUS string, "
    "SOURCE_FILE_NAME string, TOTAL_TABLES long, TABLES_LOADED long, TABLES_FAILED long, ERROR_MESSAGE string"
)
STATUS_SCHEMA = (
    "STATUS_ID long, RUN_ID long, TABLE_NAME string, STATUS string, ROWS_LOADED long, ROWS_EXPECTED long, "
    "LOAD_START_TS timestamp_ntz, LOAD_END_TS timestamp_ntz, ERROR_MESSAGE string"
)
ERRORS_SCHEMA = (
    "ERROR_ID long, RUN_ID long, TABLE_NAME string, ROW_NUMBER long, ERROR_MESSAGE string, REJECTED_ROW string"
)
COMMITS_SCHEMA = (
    "LOAD_ID string, TABLE_NAME string, RUN_ID long, LOCATION string, ROWS_LOADED long, ROWS_REJECTED long, COMMIT_TS timestamp_ntz"
)
# How many rows each log view shows.
RECENT_RUNS = 100
RECENT_STATUS = 500
RECENT_ERRORS = 500


def _t(db: str, name: str) -> str:
    return f"`{db}`.`{name}`"


def ensure_audit_tables(spark: SparkSession, db: str) -> None:
    for name, schema in ((RUNS, RUNS_SCHEMA), (STATUS, STATUS_SCHEMA), (ERRORS, ERRORS_SCHEMA), (COMMITS, COMMITS_SCHEMA)):
        if not spark.catalog.tableExists(f"{db}.{name}"):
            local_frame(spark, [], schema).write.mode("overwrite").format("parquet").saveAsTable(_t(db, name))


def _next_id(spark: SparkSession, db: str, table: str, col: str) -> int:
    row = spark.table(_t(db, table)).agg(F.coalesce(F.max(col), F.lit(0)).alias("m")).first()
    return int(row["m"]) + 1


def log_run(spark: SparkSession, db: str, run: dict, run_id: int | None = None) -> int:
    """Append a run event; a new run gets ``max(RUN_ID) + 1``. Returns the run id."""
    if run_id is None:
        run_id = _next_id(spark, db, RUNS, "RUN_ID")
    seq = spark.table(_t(db, RUNS)).where(F.col("RUN_ID") == run_id).agg(
        F.coalesce(F.max("EVENT_SEQ"), F.lit(0)).alias("m")).first()["m"] + 1
    row = (run_id, seq, run.get("run_start_ts"), run.get("run_end_ts"), run.get("status"), run.get("source_file_name"),
           run.get("total_tables", 0), run.get("tables_loaded", 0), run.get("tables_failed", 0), run.get("error_message"))
    local_frame(spark, [row], RUNS_SCHEMA).write.mode("append").insertInto(_t(db, RUNS))
    return run_id


def log_table_status(spark: SparkSession, db: str, run_id: int, rows: list[dict]) -> None:
    """Append status rows with ids ``max(STATUS_ID) + 1, + 2, ...`` in the given order."""
    if not rows:
        return
    base = _next_id(spark, db, STATUS, "STATUS_ID")
    data = [
        (base + i, run_id, r["table_name"], r["status"], r.get("rows_loaded", 0), r.get("rows_expected", 0),
         r.get("load_start_ts"), r.get("load_end_ts"), r.get("error_message"))
        for i, r in enumerate(rows)
    ]
    local_frame(spark, data, STATUS_SCHEMA).write.mode("append").insertInto(_t(db, STATUS))


def log_errors(spark: SparkSession, db: str, run_id: int, table_name: str, rejects: DataFrame) -> None:
    """Append rejected rows (``row_number``, ``error_message``, ``rejected_row`` columns) with unique ids.

    Ids are ``max + 1 + monotonically_increasing_id()``: unique without ordering every reject in one task.
    """
    base = _next_id(spark, db, ERRORS, "ERROR_ID")
    out = rejects.select(
        (F.lit(base) + F.monotonically_increasing_id()).alias("ERROR_ID"),
        F.lit(run_id).cast("long").alias("RUN_ID"),
        F.lit(table_name).alias("TABLE_NAME"),
        F.col("row_number").cast("long").alias("ROW_NUMBER"),
        F.col("error_message").alias("ERROR_MESSAGE"),
        F.col("rejected_row").cast("string").alias("REJECTED_ROW"),
    )
    out.write.mode("append").insertInto(_t(db, ERRORS))


def log_commit(spark: SparkSession, db: str, load_id: str, table: str, run_id: int, location: str, loaded: int, rejected: int) -> None:
    """Record that a load's attempt at ``location`` is a table's contents. One row in one file: there wholly or not at all."""
    row = (load_id, table, run_id, location, loaded, rejected, now())
    local_frame(spark, [row], COMMITS_SCHEMA).write.mode("append").insertInto(_t(db, COMMITS))


def commits(spark: SparkSession, db: str, table: str) -> DataFrame:
    """The loads committed to a table."""
    return spark.table(_t(db, COMMITS)).where(F.col("TABLE_NAME") == table)


def runs(spark: SparkSession, db: str) -> DataFrame:
    """Current state of every run: its latest event."""
    ev = spark.table(_t(db, RUNS))
    cols = [c for c in ev.columns if c not in ("RUN_ID", "EVENT_SEQ")]
    latest = ev.groupBy("RUN_ID").agg(F.max_by(F.struct(*cols), "EVENT_SEQ").alias("s"))
    return latest.select("RUN_ID", *[F.col(f"s.{c}").alias(c) for c in cols])


def recent_runs(spark: SparkSession, db: str, n: int = RECENT_RUNS) -> DataFrame:
    return runs(spark, db).orderBy(F.desc("RUN_START_TS"), F.desc("RUN_ID")).limit(n)


def recent_status(spark: SparkSession, db: str, n: int = RECENT_STATUS) -> DataFrame:
    return spark.table(_t(db, STATUS)).orderBy(F.desc("LOAD_START_TS"), F.desc("STATUS_ID")).limit(n)


def recent_errors(spark: SparkSession, db: str, n: int = RECENT_ERRORS) -> DataFrame:
    return spark.table(_t(db, ERRORS)).orderBy(F.desc("ERROR_ID")).limit(n)


def summary(spark: SparkSession, db: str) -> DataFrame:
    """Runs per status, with tables loaded / total and rows loaded (one row per status)."""
    r = runs(spark, db)
    rows = spark.table(_t(db, STATUS)).groupBy("RUN_ID").agg(F.sum("ROWS_LOADED").alias("rows_loaded"))
    return r.join(rows, "RUN_ID", "left").groupBy("STATUS").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("TABLES_LOADED").alias("tables_loaded"),
        F.sum("TOTAL_TABLES").alias("total_tables"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("rows_loaded"),
    )


def run_detail(spark: SparkSession, db: str, run_id: int | None = None, status: str | None = None) -> dict[str, DataFrame]:
    """A run (or runs with a status) with its table statuses and errors."""
    r = runs(spark, db)
    if status is not None:
        r = r.where(F.col("STATUS") == status)
    if run_id is not None:
        r = r.where(F.col("RUN_ID") == run_id)
    ids = r.select("RUN_ID")
    return {
        "run": r,
        "tables": spark.table(_t(db, STATUS)).join(ids, "RUN_ID", "left_semi"),
        "errors": spark.table(_t(db, ERRORS)).join(ids, "RUN_ID", "left_semi"),
    }


def now() -> _dt.datetime:
    return _dt.datetime.now()
