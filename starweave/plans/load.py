"""Loading split tables into the Spark catalog, with audit records.

* ``create_namespace`` / ``create_tables``: the database and one empty table per model table (schema from
  the model, duplicate column names dropped keeping the first);
* ``copy_into``: append a written table by column name; rows that do not fit the *target* schema are rejected into
  the errors table instead of failing the load; counts come from ``Observation`` on the write;
* ``append_by_name``: append a frame, its columns aligned by name (missing ones NULL), with the same rejects;
* ``load_table``: replace a table's contents all or nothing, once for each load id (attempt folder, commit record, pointer);
* ``load_all``: namespace → audit tables → tables → run event → each table → final run event.
  Tables fail independently; the run ends SUCCESS, PARTIAL or FAILED.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from starweave.functions.types import spark_type_of
from starweave.operators.model import Model, ModelTable
from starweave.operators.profile import is_missing
from starweave.plans import audit
from starweave.functions.frames import local_frame
from starweave.session import HASH_TEXT, written
from starweave.sources.readers import OVER, POSITION, RECORD, converted, raw_csv, read_any


def _t(db: str, name: str) -> str:
    return f"`{db}`.`{name}`"


def create_namespace(spark: SparkSession, db: str, location: str | None = None) -> dict:
    existed = spark.catalog.databaseExists(db)
    if not existed:
        loc = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`{loc}")
    return {"existed": existed, "created": not existed}


def table_schema(table: ModelTable) -> T.StructType:
    seen: set[str] = set()
    fields = []
    for c in table.columns:
        if c.name in seen:
            continue
        seen.add(c.name)
        fields.append(T.StructField(c.name, spark_type_of(c.data_type), c.nullable))
    return T.StructType(fields)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _base(spark: SparkSession, db: str, table: str) -> str:
    """Folder below which the attempts of a table are written."""
    return f"{spark.catalog.getDatabase(db).locationUri.rstrip('/')}/{table.lower()}-attempts"


def _point(spark: SparkSession, db: str, table: str, schema: T.StructType, path: str) -> None:
    """Let the table be the data at ``path``; one change of the catalogue, so that readers see the old data or the new."""
    if spark.catalog.tableExists(f"{db}.{table}"):
        now = spark.table(_t(db, table)).schema
        if [(f.name, f.dataType) for f in now.fields] == [(f.name, f.dataType) for f in schema.fields]:
            spark.sql(f"ALTER TABLE {_t(db, table)} SET LOCATION '{path}'")
            spark.catalog.refreshTable(_t(db, table))
            return
        spark.sql(f"DROP TABLE {_t(db, table)}")
    spark.sql(f"CREATE TABLE {_t(db, table)} ({_ddl(schema)}) USING parquet LOCATION '{path}'")


def create_tables(spark: SparkSession, model: Model, db: str, replace: bool = True) -> dict[str, T.StructType]:
    """One empty table per model table; without ``replace`` those that exist stay as they are. NOT NULL is enforced by the
    quality checks."""
    out = {}
    for name, t in model.tables.items():
        out[name] = table_schema(t)
        if replace or not spark.catalog.tableExists(f"{db}.{name}"):
            _point(spark, db, name, out[name], f"{_base(spark, db, name)}/empty-{uuid.uuid4().hex[:12]}")
    return out


@dataclass
class CopyResult:
    rows_parsed: int
    rows_loaded: int
    errors_seen: int
    rejects: DataFrame


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = (3, 5, 10, 19)  # of their greatest values
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _value(c: Column, kind: T.DataType, target: T.DataType) -> Column:
    """``c`` (of type ``kind``) as ``target``, NULL if it cannot be one without changing what it says."""
    if kind == target:
        return c
    if isinstance(kind, T.StringType):
        return converted(c, target.simpleString())
    whole = isinstance(target, _INTEGRAL) or (isinstance(target, T.DecimalType) and target.scale == 0)
    if whole and isinstance(kind, _FRACTIONAL):
        return F.when(c % 1 == 0, c.try_cast(target))
    return c.try_cast(target)


def _always_fits(kind: T.DataType, target: T.DataType) -> bool:
    """Whether the types alone say that every value of ``kind`` can be one of ``target``."""
    if kind == target:
        return True
    if not isinstance(kind, _INTEGRAL):
        return False
    if isinstance(target, _INTEGRAL):
        return _INTEGRAL.index(type(kind)) <= _INTEGRAL.index(type(target))
    if isinstance(target, T.DecimalType):
        return target.precision - target.scale >= _DIGITS[_INTEGRAL.index(type(kind))]
    return isinstance(target, (T.FloatType, T.DoubleType))


def _checked(frame: DataFrame, source: dict[str, Column], schema: T.StructType, surplus: Column) -> tuple[DataFrame, list[Column]]:
    """(``frame`` with ``__error``, the columns of ``schema``): a present value that cannot be converted is an error. Columns
    whose type lets no value fail are not tested row by row."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    values = {f.name: _value(source[f.name], types[f.name], f.dataType) if f.name in source else F.lit(None).cast(f.dataType)
              for f in schema.fields}
    message = F.when(surplus, "too many fields")
    tested = [F.when(~is_missing(source[f.name], types[f.name]) & values[f.name].isNull(), F.lit(f.name))
              for f in schema.fields if f.name in source and not _always_fits(types[f.name], f.dataType)]
    if tested:
        failed = F.array_compact(F.array(F.lit(None).cast("string"), *tested))
        message = message.when(F.size(failed) > 0, F.concat(F.lit("cannot convert: "), F.array_join(failed, ", ")))
    return frame.withColumn("__error", message), [v.alias(n) for n, v in values.items()]


def _split_rows(marked: DataFrame, values: list[Column], number: Column, text: Column, name: str, write: Callable[[DataFrame], None]) -> CopyResult:
    """Write the rows without an error; both kinds are counted while they are written."""
    obs = Observation(name)
    seen = marked.observe(obs, F.count_if(F.col("__error").isNull()).alias("good"), F.count("__error").alias("bad"))
    write(seen.where(F.col("__error").isNull()).select(*values))
    rejects = marked.where(F.col("__error").isNotNull()).select(
        number.alias("row_number"), F.col("__error").alias("error_message"), text.alias("rejected_row"))
    loaded, errors = int(obs.get.get("good", 0)), int(obs.get.get("bad", 0))
    return CopyResult(loaded + errors, loaded, errors, rejects)


def append_by_name(spark: SparkSession, df: DataFrame, db: str, table: str) -> CopyResult:
    """Append a frame, its columns aligned by name (missing ones NULL). Rows with a value that does not fit its column are
    rejected, with their text as JSON; nothing turns into NULL."""
    schema = spark.table(_t(db, table)).schema
    marked, values = _checked(df, {n: F.col(f"`{n}`") for n in df.columns}, schema, F.lit(False))
    text = F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns]))
    return _split_rows(marked, values, F.lit(None).cast("long"), text, f"append_{table}",
                       lambda good: good.write.mode("append").insertInto(_t(db, table)))


def _numbered(raw: DataFrame) -> DataFrame:
    """``raw`` (a written table of ``raw_csv``) with each row's number within its file, from counts per split."""
    file, block, pos = POSITION
    splits = raw.groupBy(file, block).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col(file).alias("s_file"), F.col(block).alias("s_block"), "first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return raw.join(splits, (F.col(file) == F.col("s_file")) & (F.col(block) == F.col("s_block"))).withColumn(
        "__row", F.col("before") + F.col(pos) - F.col("first") + 1)


def _copy(spark: SparkSession, path: str, schema: T.StructType, fmt: str, name: str, write: Callable[[DataFrame], None]) -> CopyResult:
    if fmt == "csv":
        parsed = _numbered(written(raw_csv(spark, path), "parsed"))
        names = [c for c in parsed.columns if c not in (OVER, RECORD, *POSITION, "s_file", "s_block", "first", "before", "__row")]
        source = {n: F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names}
        surplus, number, text = F.col(OVER), F.col("__row"), F.col(RECORD)
    else:
        parsed = read_any(spark, path, fmt)
        names = parsed.columns
        source = {n: F.col(f"`{n}`") for n in names}
        surplus, number = F.lit(False), F.lit(None).cast("long")
        text = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
        parsed = parsed if fmt == "parquet" else written(parsed, "parsed")
    marked, values = _checked(parsed, source, schema, surplus)
    return _split_rows(marked, values, number, text, name, write)


def copy_into(spark: SparkSession, path: str, db: str, table: str, fmt: str = "parquet") -> CopyResult:
    """Append a written file set to a table by column name; rows that do not fit are rejected, not fatal.

    A row is rejected if it has more fields than its header, or if a value that is present cannot be converted to
    the column's type; no value is silently turned into NULL. Rejects carry their row number within the file (CSV; other
    formats have none), what was wrong, and the row's text. The rows are parsed once, into the shared folder.
    """
    return _copy(spark, path, spark.table(_t(db, table)).schema, fmt, f"copy_{table}",
                 lambda good: good.write.mode("append").insertInto(_t(db, table)))


@dataclass
class Commit:
    """What one load did to one table."""

    rows_loaded: int
    errors_seen: int
    location: str
    repeated: bool


def load_table(spark: SparkSession, path: str, db: str, table: str, schema: T.StructType, load_id: str, run_id: int,
               fmt: str = "parquet") -> Commit:
    """Make the files at ``path`` the contents of a table, all or nothing, and once for each ``load_id``.

    The rows go to a folder of their own (an attempt); then a commit record is written, and then the table is pointed at
    that folder. Whatever fails before the record leaves the table as it was, and the attempt is never read. A load whose
    record exists is not done again: the table is pointed at the attempt that the record names (a failure between the two
    last steps is mended by that), unless a later load has been committed since.
    """
    done = audit.commits(spark, db, table).orderBy("COMMIT_TS", "LOCATION").collect()  # loads of one table
    for c in done:
        if c["LOAD_ID"] == load_id:
            if c == done[-1]:
                _point(spark, db, table, schema, c["LOCATION"])
            return Commit(c["ROWS_LOADED"], c["ROWS_REJECTED"], c["LOCATION"], True)
    attempt = f"{_base(spark, db, table)}/{run_id}-{uuid.uuid4().hex[:12]}"
    res = _copy(spark, path, schema, fmt, f"load_{table}", lambda good: good.write.options(**HASH_TEXT).parquet(attempt))
    if res.errors_seen:
        audit.log_errors(spark, db, run_id, table, res.rejects)
    audit.log_commit(spark, db, load_id, table, run_id, attempt, res.rows_loaded, res.errors_seen)
    _point(spark, db, table, schema, attempt)
    return Commit(res.rows_loaded, res.errors_seen, attempt, False)


def validate_row_counts(spark: SparkSession, db: str, expected: dict[str, int]) -> DataFrame:
    """(table, expected, actual, difference, passed) for every table in ``expected``."""
    parts = [
        spark.table(_t(db, t)).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(t).alias("table_name"), "actual")
        for t in expected
    ]
    actual = parts[0]
    for p in parts[1:]:
        actual = actual.unionByName(p)
    exp = local_frame(spark, list(expected.items()), "table_name string, expected long")
    return exp.join(actual, "table_name", "left").select(
        "table_name", "expected", F.coalesce("actual", F.lit(0)).alias("actual"),
        (F.coalesce("actual", F.lit(0)) - F.col("expected")).alias("difference"),
        (F.coalesce("actual", F.lit(0)) == F.col("expected")).alias("passed"))


def run_status(loaded: int, failed: int) -> str:
    return audit.SUCCESS if failed == 0 else (audit.PARTIAL if loaded > 0 else audit.FAILED)


def load_all(
    spark: SparkSession,
    model: Model,
    paths: dict[str, str],
    source_name: str,
    db: str,
    fmt: str = "parquet",
    expected_rows: dict[str, int] | None = None,
    location: str | None = None,
    load_id: str | None = None,
) -> dict:
    """Load every written table; returns run id, per-table results and overall status.

    Each table is replaced all or nothing (``load_table``). With a ``load_id`` of the caller's, the tables that a run of
    that id has loaded are left as they are when it is run again, so that a broken run can be repeated whole.
    """
    start = audit.now()
    ns = create_namespace(spark, db, location)
    audit.ensure_audit_tables(spark, db)
    schemas = create_tables(spark, model, db, replace=False)
    load_id = load_id or f"load-{uuid.uuid4().hex}"
    run_id = audit.log_run(spark, db, {"run_start_ts": start, "status": audit.IN_PROGRESS, "source_file_name": source_name,
                                       "total_tables": len(paths)})
    status_rows, loaded, failed = [], 0, 0
    for table, path in paths.items():
        t0 = audit.now()
        row = {"table_name": table, "rows_loaded": 0, "load_start_ts": t0,
               "rows_expected": (expected_rows or {}).get(table, 0)}
        try:
            if table not in model.tables:
                raise ValueError(f"table {table} is not in the model")
            res = load_table(spark, path, db, table, schemas[table], load_id, run_id, fmt)
            row.update(status=audit.SUCCESS, rows_loaded=res.rows_loaded)  # an empty file is a success with 0 rows
            loaded += 1
        except Exception as exc:  # noqa: BLE001 - a failing table does not stop the others
            row.update(status=audit.FAILED, error_message=str(exc))
            failed += 1
        row["load_end_ts"] = audit.now()
        status_rows.append(row)
    audit.log_table_status(spark, db, run_id, status_rows)
    status = run_status(loaded, failed)
    audit.log_run(spark, db, {"run_start_ts": start, "run_end_ts": audit.now(), "status": status,
                              "source_file_name": source_name, "total_tables": len(paths), "tables_loaded": loaded,
                              "tables_failed": failed}, run_id=run_id)
    return {"run_id": run_id, "status": status, "tables": status_rows, "namespace": ns,
            "overall_success": failed == 0}
