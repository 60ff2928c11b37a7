"""Registered queries about files and loads, over files that Spark writes from the test tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from entry_plans import FIXED_LOAD_TS, modelled
from starweave.functions.frames import local_frame
from starweave.functions.types import spark_type_of
from starweave.operators import quality
from starweave.operators.keys import candidate_keys
from starweave.operators.model import infer_model
from starweave.operators.profile import profile_tables
from starweave.operators.split import split
from starweave.plans import audit, load, sinks
from starweave.session import scratch_path
from starweave.sources import file_metadata, read_csv, validate_source
from starweave.sources.readers import raw_csv


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _lines(df: DataFrame, header: str, line, path: str) -> None:
    """Text files with a header line each; nothing is quoted or escaped."""
    df.select(line.alias(header)).write.mode("append").option("header", True).option("sep", "\u0001").option("quote", "").option(
        "escape", "").option("emptyValue", "").csv(path)


def csv_permuted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in files whose columns stand in other orders, one column more here and one less there."""
    c, out = _read(spark, sf_dir, "customer"), _fresh(spark, "permuted")
    for k, columns in enumerate((["c_custkey", "c_name", "c_nationkey"], ["c_nationkey", "c_custkey", "c_acctbal"], ["C_NAME", "c_custkey"])):
        part = c.where(F.col("c_custkey") % 3 == k).withColumnRenamed("c_name", "C_NAME" if k == 2 else "c_name")
        part.select(*columns).write.mode("append").option("header", True).csv(out)
    return read_csv(spark, out).select("c_custkey", F.col("c_name"), F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_acctbal")


def csv_multiline_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a header and with fields that hold line breaks, in files read by many splits."""
    out = _fresh(spark, "lines")
    docs = _read(spark, sf_dir, "documents")
    docs.select("doc_id", F.col("text").alias("text,\nas it is"), "lang").write.option("header", True).option("escape", '"').csv(out)
    back = read_csv(spark, out, na_values=("",))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text,\nas it is", 256).alias("text_sha256"), "lang")


def csv_overlong_empty_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with more fields than the header, of which the first ones are empty, and short lines."""
    c, out = _read(spark, sf_dir, "customer"), _fresh(spark, "overlong")
    tail = F.element_at(F.array(F.lit(",,9"), F.lit(","), F.lit(""), F.concat(F.lit(",,"), F.col("c_name"))), F.col("c_custkey").cast("int") % 4 + 1)
    line = F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey").cast("string")).otherwise(
        F.concat_ws(",", "c_custkey", F.concat(F.col("c_nationkey").cast("string"), tail)))
    _lines(c, "c_custkey,c_nationkey", line, out)
    raw = raw_csv(spark, out)
    return raw.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("double").alias("c_nationkey"),
                      F.col("__over").alias("rejected"), F.col("__record").alias("line"))


def append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items appended by name to narrower types: values that do not fit are rejected, none becomes NULL."""
    db = f"sw_rejects_{uuid.uuid4().hex[:12]}"
    load.create_namespace(spark, db, scratch_path(spark, db))
    spark.sql(f"CREATE TABLE {db}.t (l_orderkey BIGINT, l_linenumber INT, l_quantity INT, note STRING) USING parquet")
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_orderkey") % 50 == 0, F.lit("7D")).otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        (F.col("l_quantity") + F.when(F.col("l_orderkey") % 40 == 0, 0.5).otherwise(0.0)).alias("l_quantity"))
    res = load.append_by_name(spark, li, db, "t")
    good = spark.table(f"{db}.t").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").cast("long").alias("numbers"),
                                      F.count("l_quantity").alias("quantities"))
    bad = res.rejects.groupBy(F.col("error_message").alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("numbers"), F.count("rejected_row").alias("quantities"))
    return good.select(F.lit("loaded").alias("reason"), "rows", "numbers", "quantities").unionByName(bad)


def wide_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of up to 38 digits through CSV into a NUMBER(38,0) column; longer ones are rejected."""
    db, out = f"sw_wide_{uuid.uuid4().hex[:12]}", _fresh(spark, "wide")
    load.create_namespace(spark, db, scratch_path(spark, db))
    kind = spark_type_of("NUMBER(38,0)").simpleString()
    spark.sql(f"CREATE TABLE {db}.t (o_orderkey BIGINT, n {kind}) USING parquet")
    digits = F.rpad(F.concat(F.lit("-1"), F.col("o_orderkey").cast("string")), 19 + F.col("o_orderkey") % 23, F.lit("7"))
    _read(spark, sf_dir, "orders").select("o_orderkey", digits.alias("n")).write.option("header", True).csv(out)
    res = load.copy_into(spark, out, db, "t", "csv")
    kept = spark.table(f"{db}.t").select("o_orderkey", F.col("n").cast("string").alias("n"), F.lit("").alias("error"))
    key = F.regexp_extract("rejected_row", r"^(\d+)", 1).cast("long")
    return kept.unionByName(res.rejects.select(key.alias("o_orderkey"), F.lit("").alias("n"), F.col("error_message").alias("error")))


def _loads(spark: SparkSession, sf_dir: str, loads: list[tuple[str, str]]) -> DataFrame:
    """Loads of (load id, kind of input: all, odd orders, or broken) one after the other; the tables at the end."""
    db = f"sw_loads_{uuid.uuid4().hex[:12]}"
    m = modelled(spark, sf_dir)
    paths = {}
    for kind in {k for _, k in loads} & {"all", "odd"}:
        df = m.hashed if kind == "all" else m.hashed.where(F.col("transaction_id") % 2 == 1)
        tables = split(df, m.model, "orders_wide", order_by="transaction_id", load_ts=FIXED_LOAD_TS, cache_input=False)
        rows = sinks.write_tables(spark, tables, _fresh(spark, f"split-{kind}")).collect()  # one row per table
        paths[kind] = {r["table_name"]: r["path"] for r in rows}
    for load_id, kind in loads:
        files = paths[kind] if kind in paths else {t: f"{p}-missing" for t, p in next(iter(paths.values())).items()}
        load.load_all(spark, m.model, files, "orders_wide", db, load_id=load_id, location=scratch_path(spark, db))
    commits = spark.table(f"{db}.{audit.COMMITS}").groupBy(F.col("TABLE_NAME").alias("table_name")).agg(F.count(F.lit(1)).alias("commits"))
    counts = [spark.table(f"{db}.{t}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in m.model.tables]
    return reduce(DataFrame.unionByName, counts).join(commits, "table_name").select("table_name", "rows", "commits")


def load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load three times: each table holds its rows once, under one commit."""
    return _loads(spark, sf_dir, [("monday", "all")] * 3)


def load_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, another that breaks in every table, and a third: the broken one leaves no trace in the tables."""
    return _loads(spark, sf_dir, [("monday", "all"), ("tuesday", "broken"), ("wednesday", "odd"), ("thursday", "broken")])


def dq_types_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type checks of the split tables after order keys have become text, and amounts text, in the fact."""
    m = modelled(spark, sf_dir)
    changed = {"transaction_id": "string", "total_amount": "string"}
    fact = m.tables["FACT_MAIN"]
    fact = fact.select(*[F.col(c).cast(changed.get(c, fact.schema[c].dataType)).alias(c) for c in fact.columns])
    frames = m.tables | {"FACT_MAIN": fact}
    parts = [quality.check_types(spark, frames[n], t) for n, t in m.model.tables.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "passed", "violation_count", "message", F.array_join("sample", "; ").alias("sample"))


def validate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation of a path that does not exist, of an unknown type, of a damaged file and of a good one."""
    damaged = _fresh(spark, "damaged") + ".parquet"
    _read(spark, sf_dir, "customer").select("c_name").write.text(damaged)
    cases = {"missing": f"{sf_dir}/no_such_table.parquet", "unknown": f"{sf_dir}/customer.xml", "damaged": damaged, "good": f"{sf_dir}/customer.parquet"}
    _read(spark, sf_dir, "customer").select("c_name").write.text(unknown := _fresh(spark, "unknown") + ".xml")
    rows = []
    for name, path in (cases | {"unknown": unknown}).items():
        ok, message = validate_source(spark, path)
        rows.append((name, ok, None if message is None else message.split(": ")[0]))
    return local_frame(spark, rows, "source string, ok boolean, message string")


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a folder of text files, one for each nation, from the listing alone."""
    out = _fresh(spark, "sizes")
    names = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), "c_nationkey")
    names.repartition(8, "c_nationkey").write.partitionBy("c_nationkey").text(out)
    nation = F.regexp_extract("file_path", r"c_nationkey=(\d+)", 1).cast("long")
    return file_metadata(spark, out).groupBy(nation.alias("c_nationkey")).agg(F.sum("size_bytes").alias("size_bytes"))


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview of each table shows (100 at most), and how many of them are rows of the table."""
    out = []
    for t, key in (("region", "r_regionkey"), ("orders", "o_orderkey"), ("documents", "doc_id")):
        df = _read(spark, sf_dir, t)
        shown = profile_tables(spark, {t: df}).preview(t)
        out.append(shown.join(df.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows"))
    return reduce(DataFrame.unionByName, out)


def dim_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension written in the order of its key: per file, rows that are out of order."""
    m, out = modelled(spark, sf_dir), _fresh(spark, "layout")
    sinks.write_tables(spark, {"DIM_CUSTOMER": m.tables["DIM_CUSTOMER"]}, out, sort_within={"DIM_CUSTOMER": ["customer_id_NK"]}).collect()
    back = spark.read.parquet(sinks.table_path(out, "DIM_CUSTOMER")).select(
        "customer_id_NK", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
    before = back.select("file", (F.col("n") + 1).alias("n"), F.col("customer_id_NK").alias("last"))
    return back.join(before, ["file", "n"], "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("last") >= F.col("customer_id_NK")).alias("out_of_order"))


def fact_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of a table without a key: its surrogate key hashes the first five columns."""
    li = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("line_count"))
    p = profile_tables(spark, {"lineitem": li})
    model = infer_model(p, candidate_keys(p), "lineitem", include_date_dim=False)
    fact = split(li, model, "lineitem", order_by="line_count", load_ts=FIXED_LOAD_TS, cache_input=False)["FACT_MAIN"]
    return fact.groupBy("FACT_SK").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {f.__name__: f for f in (
    csv_permuted_headers, csv_multiline_header, csv_overlong_empty_field, append_rejects, wide_integers, load_twice, load_after_failure,
    dq_types_violations, validate_failures, file_sizes, preview_rows, dim_layout, fact_without_key)}

_SPLIT_ROWS = """
SELECT 'FACT_MAIN' AS table_name, count(*) AS rows, {n} AS commits FROM o
UNION ALL SELECT 'DIM_CUSTOMER', count(DISTINCT customer_id), {n} FROM o
UNION ALL SELECT 'DIM_ORDER', count(DISTINCT order_status), {n} FROM o
UNION ALL SELECT 'DIM_TRANSACTION', count(DISTINCT transaction_id), {n} FROM o
UNION ALL SELECT 'DIM_DATE', count(DISTINCT CAST(order_date AS DATE)), {n} FROM o
"""


def oracles(orders_wide_sql: str) -> dict[str, str]:
    def rows(where: str, commits: int) -> str:
        return f"WITH o AS (SELECT * FROM ({orders_wide_sql}) {where}) " + _SPLIT_ROWS.format(n=f"CAST({commits} AS BIGINT)")

    good = "'All columns match expected types'"
    tail = "CASE c_custkey % 4 WHEN 0 THEN ',,9' WHEN 1 THEN ',' WHEN 2 THEN '' ELSE ',,' || c_name END"
    digits = "rpad('-1' || o_orderkey, CAST(19 + o_orderkey % 23 AS INTEGER), '7')"
    return {
        "csv_permuted_headers": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS c_name, "
            "CASE WHEN c_custkey % 3 <> 2 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal END AS c_acctbal FROM customer",
        "csv_multiline_header": "SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS text_sha256, lang FROM documents",
        "csv_overlong_empty_field": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey, "
            "c_custkey % 7 <> 0 AND c_custkey % 4 <> 2 AS rejected, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) "
            f"ELSE c_custkey || ',' || c_nationkey || {tail} END AS line FROM customer",
        "append_rejects": "SELECT reason, count(*) AS rows, CAST(CASE WHEN reason = 'loaded' THEN sum(l_linenumber) ELSE 0 END AS BIGINT) AS numbers, "
            "count(*) AS quantities FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 40 <> 0 AND l_orderkey % 50 <> 0 THEN 'loaded' ELSE 'cannot convert: ' || "
            "concat_ws(', ', CASE WHEN l_orderkey % 50 = 0 THEN 'l_linenumber' END, CASE WHEN l_orderkey % 40 = 0 THEN 'l_quantity' END) END AS reason "
            "FROM lineitem) GROUP BY reason",
        "wide_integers": f"SELECT o_orderkey, CASE WHEN length(d) <= 39 THEN d ELSE '' END AS n, CASE WHEN length(d) <= 39 THEN '' ELSE 'cannot convert: n' END AS error "
            f"FROM (SELECT o_orderkey, {digits} AS d FROM orders)",
        "load_twice": rows("", 1),
        "load_after_failure": rows("WHERE transaction_id % 2 = 1", 2),
        "dq_types_violations": "SELECT 'FACT_MAIN' AS table_name, false AS passed, CAST(2 AS BIGINT) AS violation_count, 'Type mismatches in 2 columns' AS message, "
            "'total_amount: expected FLOAT, found string; transaction_id: expected NUMBER(38,0), found string' AS sample "
            f"UNION ALL SELECT t, true, 0, {good}, '' FROM (VALUES ('DIM_CUSTOMER'), ('DIM_ORDER'), ('DIM_TRANSACTION'), ('DIM_DATE')) v(t)",
        "validate_failures": "SELECT * FROM (VALUES ('missing', false, 'File does not exist'), ('unknown', false, 'Unsupported file type'), "
            "('damaged', false, 'File validation failed'), ('good', true, NULL)) v(source, ok, message)",
        "file_sizes": "SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size_bytes FROM customer GROUP BY c_nationkey",
        "preview_rows": "SELECT 'region' AS table_name, least(count(*), 100) AS rows FROM region UNION ALL SELECT 'orders', least(count(*), 100) FROM orders "
            "UNION ALL SELECT 'documents', least(count(*), 100) FROM documents",
        "dim_layout": f"SELECT count(DISTINCT customer_id) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM ({orders_wide_sql})",
        "fact_without_key": "SELECT sha256(l_returnflag || '|' || l_linestatus || '|' || l_linenumber) AS FACT_SK, count(*) AS rows FROM lineitem "
            "GROUP BY l_returnflag, l_linestatus, l_linenumber",
    }
