"""Data-quality checks over split tables; every result is a DataFrame row.

* primary key: duplicate groups by ``groupBy(pk).count()`` (partial aggregation absorbs hot keys);
* foreign key: distinct non-null FKs *before* a ``left_anti`` join to the dimension keys;
* NULL constraints: one aggregate with a ``count_if`` per required column;
* types: model types against the schema of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from starweave.functions.types import spark_type_of
from starweave.operators.model import Model, ModelTable
from starweave.operators.profile import is_missing
from starweave.functions.frames import local_frame
from starweave.session import written

RESULT_SCHEMA = (
    "table_name string, check_name string, column_name string, passed boolean, violation_count long, "
    "violation_percentage double, message string, sample array<string>"
)
# How many orphan keys a foreign-key check reports, and the check messages.
ORPHAN_SAMPLE = 100
SAMPLE = 10  # violations shown in a check's result
MSG_NO_PK = "No primary key columns specified"
MSG_PK_DUPLICATES = "Found %d duplicate primary key rows"
MSG_PK_UNIQUE = "Primary key is unique"
MSG_FK_ORPHANS = "Found %d orphaned foreign keys"
MSG_FK_VALID = "All foreign keys valid"
MSG_NULLS_FOUND = "Found nulls in %d required columns"
MSG_NULLS_NONE = "All required columns have no nulls"
MSG_TYPES_MISMATCH = "Type mismatches in %d columns"
MSG_TYPES_MATCH = "All columns match expected types"
MSG_FILE_LOAD = "Failed to load file: "


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def duplicate_keys(df: DataFrame, pk: list[str]) -> DataFrame:
    """Every key value held by more than one row, with its row count (NULL equals NULL)."""
    return df.groupBy(*[_q(c) for c in pk]).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def _with_sample(counts: DataFrame, shown: DataFrame) -> DataFrame:
    """One row (n, sample): the count of ``counts`` (n) and the least ``SAMPLE`` texts of ``shown`` (text)."""
    top = shown.orderBy("text").limit(SAMPLE).agg(F.sort_array(F.collect_list("text")).alias("sample"))
    both = counts.select("n", F.lit(None).cast("array<string>").alias("sample")).unionByName(
        top.select(F.lit(None).cast("long").alias("n"), "sample"))
    return both.agg(F.max("n").alias("n"), F.max("sample").alias("sample"))


def check_pk(df: DataFrame, pk: list[str], table_name: str) -> DataFrame:
    spark = df.sparkSession
    if not pk:
        return local_frame(spark,
            [(table_name, "primary_key_uniqueness", None, False, 0, None, MSG_NO_PK, [])],
            RESULT_SCHEMA,
        )
    keys = duplicate_keys(df, pk)
    dup = _with_sample(
        keys.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("n")),
        keys.select(F.concat_ws("|", *[F.coalesce(_q(c).cast("string"), F.lit("NULL")) for c in pk]).alias("text")))
    return dup.select(
        F.lit(table_name).alias("table_name"), F.lit("primary_key_uniqueness").alias("check_name"),
        F.lit(",".join(pk)).alias("column_name"), (F.col("n") == 0).alias("passed"),
        F.col("n").alias("violation_count"), F.lit(None).cast("double").alias("violation_percentage"),
        F.when(F.col("n") > 0, F.format_string(MSG_PK_DUPLICATES, F.col("n")))
        .otherwise(F.lit(MSG_PK_UNIQUE)).alias("message"), "sample",
    )


def orphan_keys(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Distinct non-null FK values with no dimension row."""
    fks = fact.select(_q(fk).alias("key")).where(F.col("key").isNotNull()).distinct()
    pks = dim.select(_q(pk).alias("key")).where(F.col("key").isNotNull()).distinct()
    return fks.join(pks, "key", "left_anti")


def orphan_sample(fact: DataFrame, dim: DataFrame, fk: str, pk: str, n: int = ORPHAN_SAMPLE) -> DataFrame:
    """The ``n`` smallest orphan keys (a top-k, never a collect of all orphans)."""
    return orphan_keys(fact, dim, fk, pk).orderBy("key").limit(n)


def check_fk(fact: DataFrame, dim: DataFrame, fk: str, pk: str, label: str) -> DataFrame:
    """Count of distinct orphan FK values (NULL FKs are not orphans); see ``orphan_sample`` for the keys."""
    keys = orphan_keys(fact, dim, fk, pk)
    n = _with_sample(keys.agg(F.count(F.lit(1)).alias("n")), keys.select(F.col("key").cast("string").alias("text")))
    return n.select(
        F.lit(label).alias("table_name"), F.lit("foreign_key_integrity").alias("check_name"),
        F.lit(fk).alias("column_name"), (F.col("n") == 0).alias("passed"),
        F.col("n").alias("violation_count"), F.lit(None).cast("double").alias("violation_percentage"),
        F.when(F.col("n") > 0, F.format_string(MSG_FK_ORPHANS, F.col("n")))
        .otherwise(F.lit(MSG_FK_VALID)).alias("message"), "sample",
    )


def null_counts(df: DataFrame, columns: list[str], table_name: str) -> DataFrame:
    """(table, column, null_count, null_percentage) of the given columns (NaN counts as NULL); one aggregate."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return local_frame(df.sparkSession, [], "table_name string, column_name string, null_count long, null_percentage double")
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(is_missing(_q(c), df.schema[c].dataType)).alias(f"n{i}")
                                                   for i, c in enumerate(present)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
                               for i, c in enumerate(present)]))
    return one.select("__n", rows.alias("r")).select(
        F.lit(table_name).alias("table_name"), "r.column_name", "r.null_count",
        F.when(F.col("__n") > 0, F.round(F.col("r.null_count") * 100.0 / F.col("__n"), 2)).otherwise(0.0)
        .alias("null_percentage"),
    )


def null_violations(df: DataFrame, required: list[str], table_name: str) -> DataFrame:
    """``null_counts`` of the required columns that hold NULLs."""
    return null_counts(df, required, table_name).where(F.col("null_count") > 0)


def check_nulls(df: DataFrame, required: list[str], table_name: str) -> DataFrame:
    v = null_violations(df, required, table_name)
    each = F.concat("column_name", F.lit(": "), F.col("null_count").cast("string"))
    summary = v.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("null_count"), F.lit(0)).cast("long").alias("n"),
                    F.sort_array(F.collect_list(each)).alias("sample"))  # one entry per column
    return summary.select(
        F.lit(table_name).alias("table_name"), F.lit("null_constraints").alias("check_name"),
        F.lit(None).cast("string").alias("column_name"), (F.col("k") == 0).alias("passed"),
        F.col("n").alias("violation_count"), F.lit(None).cast("double").alias("violation_percentage"),
        F.when(F.col("k") > 0, F.format_string(MSG_NULLS_FOUND, F.col("k")))
        .otherwise(F.lit(MSG_NULLS_NONE)).alias("message"), "sample",
    )


def _type_family(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (isinstance(dt, T.DecimalType) and dt.scale == 0):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.StringType):
        return "string"
    return dt.simpleString()


def type_mismatches(spark: SparkSession, df: DataFrame, table: ModelTable) -> DataFrame:
    """(table, column, expected, actual) for every modelled column whose data type family differs;
    columns missing from the data are ignored."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = [
        (table.name, c.name, c.data_type, _type_family(spark_type_of(c.data_type)), _type_family(actual[c.name]),
         actual[c.name].simpleString())
        for c in table.columns if c.name in actual
    ]
    frame = local_frame(spark, 
        rows, "table_name string, column_name string, expected string, expected_family string, "
              "actual_family string, actual string"
    )
    return frame.where(F.col("expected_family") != F.col("actual_family")).select(
        "table_name", "column_name", "expected", "actual"
    )


def value_type_violations(df: DataFrame, expected: dict[str, str], table_name: str) -> DataFrame:
    """Value-level type check: per column, the non-null values that do not convert to the expected Spark
    type (``try_cast``), as a count and a share of the non-null values. One aggregate for all columns."""
    present = [(c, t) for c, t in expected.items() if c in df.columns]
    if not present:
        return local_frame(df.sparkSession, [], "table_name string, column_name string, expected string, "
                                                "failed_count long, failed_percentage double")
    aggs = []
    for i, (c, t) in enumerate(present):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull())
                 .alias(f"f{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("expected"), F.col(f"n{i}").alias("n"),
                 F.col(f"f{i}").alias("failed_count"))
        for i, (c, t) in enumerate(present)
    ]))
    return one.select(rows.alias("r")).select(
        F.lit(table_name).alias("table_name"), "r.column_name", "r.expected", "r.failed_count",
        F.when(F.col("r.n") > 0, F.round(F.col("r.failed_count") * 100.0 / F.col("r.n"), 2)).otherwise(0.0)
        .alias("failed_percentage"))


def check_types(spark: SparkSession, df: DataFrame, table: ModelTable) -> DataFrame:
    each = F.concat("column_name", F.lit(": expected "), "expected", F.lit(", found "), "actual")
    m = type_mismatches(spark, df, table).agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(each)).alias("sample"))
    return m.select(
        F.lit(table.name).alias("table_name"), F.lit("data_types").alias("check_name"),
        F.lit(None).cast("string").alias("column_name"), (F.col("k") == 0).alias("passed"),
        F.col("k").cast("long").alias("violation_count"), F.lit(None).cast("double").alias("violation_percentage"),
        F.when(F.col("k") > 0, F.format_string(MSG_TYPES_MISMATCH, F.col("k")))
        .otherwise(F.lit(MSG_TYPES_MATCH)).alias("message"), "sample",
    )


def load_split_tables(spark: SparkSession, model: Model, paths: dict[str, str], fmt: str = "parquet"
                      ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Read written split tables back with the *model* schema (no type re-inference). A table that cannot
    be read yields a failed ``file_load`` check row instead of stopping the others."""
    from starweave.plans.load import table_schema
    from starweave.sources.readers import read_with_schema

    tables: dict[str, DataFrame] = {}
    failures = []
    for name, path in paths.items():
        try:
            if name not in model.tables:
                raise ValueError(f"table {name} is not in the model")
            df = read_with_schema(spark, path, table_schema(model.tables[name]), fmt)
            df.limit(1).collect()  # surfaces missing or unreadable files now
            tables[name] = df
        except Exception as exc:  # noqa: BLE001 - recorded as a check row
            failures.append((name, "file_load", None, False, None, None, f"{MSG_FILE_LOAD}{exc}", []))
    return tables, local_frame(spark, failures, RESULT_SCHEMA)


def _checked_columns(model: Model, name: str, df: DataFrame) -> DataFrame:
    """The columns of a table that ``run_all`` reads, written once."""
    table = model.tables[name]
    read = {*table.primary_key, *(c.name for c in table.columns if not c.nullable),
            *(fc for ft, fc, _, _ in model.relationships if ft == name), *(tc for _, _, tt, tc in model.relationships if tt == name)}
    columns = [_q(c) for c in dict.fromkeys(df.columns) if c in read]
    return written(df.select(*columns), f"checked-{name.lower()}") if columns else df


def run_all(model: Model, tables: dict[str, DataFrame], include_types: bool = False) -> DataFrame:
    """PK and NULL checks per table, FK check per relationship (tables missing from ``tables`` are
    skipped), optionally type checks; one result frame.

    Several checks read each table: the columns they read are written to the shared folder once, so that a table that is
    still a plan (a split, files of text) is not computed anew for each check."""
    spark = model.spark
    parts: list[DataFrame] = []
    whole, tables = tables, {n: _checked_columns(model, n, df) for n, df in tables.items() if n in model.tables}
    for name, t in model.tables.items():
        if name not in tables:
            continue
        df = tables[name]
        if t.primary_key:
            parts.append(check_pk(df, t.primary_key, name))
        required = [c.name for c in t.columns if not c.nullable]
        if required:
            parts.append(check_nulls(df, required, name))
        if include_types:
            parts.append(check_types(spark, whole[name], t))
    for ft, fc, tt, tc in model.relationships:
        if ft in tables and tt in tables:
            parts.append(check_fk(tables[ft], tables[tt], fc, tc, f"{ft} -> {tt}"))
    if not parts:
        return local_frame(spark, [], RESULT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("overall_passed"),
                       F.count(F.lit(1)).alias("checks"))
