"""

Every query reads the driver's test tables (or frames Spark derives from them) in full. Column names
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.functions.rules import DATE_NAME_PATTERN, ID_PATTERN, MEASURE_TERMS
from starweave.operators import quality
from starweave.operators.keys import candidate_keys
from starweave.operators.model import recommend_clustering
from starweave.operators.profile import histogram, profile_tables
from starweave.operators.split import resolve_fk
import entry_sources
from entry_plans import catalogue_profile, modelled, profile_of, wide_input
from starweave.sources.nested import flatten_nested
from entry_wide import ORDERS_WIDE_SQL, SALES_WIDE_SQL

if find_spec("starweave.llm") and find_spec("corpus_pipeline"):  # an optional subpackage with its own queries and SQL
    import corpus_pipeline
    from starweave.llm import queries as llm_queries
else:
    llm_queries = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Column layout of the driver's tables: (name, kind by Spark type) — used to write the oracle SQL.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "INTEGER"), ("r_name", "STRING")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "STRING"), ("n_regionkey", "INTEGER")],
    "customer": [("c_custkey", "INTEGER"), ("c_name", "STRING"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "FLOAT"), ("c_mktsegment", "STRING")],
    "supplier": [("s_suppkey", "INTEGER"), ("s_name", "STRING"), ("s_nationkey", "INTEGER"), ("s_acctbal", "FLOAT")],
    "part": [("p_partkey", "INTEGER"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INTEGER"), ("p_retailprice", "FLOAT")],
    "orders": [("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "STRING"),
               ("o_totalprice", "FLOAT"), ("o_orderdate", "DATE"), ("o_orderpriority", "STRING")],
    "lineitem": [("l_orderkey", "INTEGER"), ("l_partkey", "INTEGER"), ("l_suppkey", "INTEGER"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "FLOAT"), ("l_extendedprice", "FLOAT"),
                 ("l_discount", "FLOAT"), ("l_tax", "FLOAT"), ("l_returnflag", "STRING"),
                 ("l_linestatus", "STRING"), ("l_shipdate", "DATE")],
    "events": [("event_id", "INTEGER"), ("ts", "DATE"), ("user_id", "INTEGER"), ("event_type", "STRING"),
               ("value", "FLOAT"), ("props", "STRING")],
    "documents": [("doc_id", "INTEGER"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"),
                  ("n_chars", "INTEGER")],
    "embeddings": [("vec_id", "INTEGER"), ("embedding", "STRING"), ("label", "INTEGER")],
    "pages": [("page_id", "INTEGER"), ("url", "STRING"), ("html", "STRING")],
    "benchmark": [("item_id", "INTEGER"), ("text", "STRING")],
    "labels": [("doc_id", "INTEGER"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "conversations": [("conv_id", "INTEGER"), ("turn", "INTEGER"), ("role", "STRING"), ("text", "STRING")],
    "sales_wide": [("transaction_id", "INTEGER"), ("customer_id", "INTEGER"), ("customer_name", "STRING"),
                   ("customer_segment", "STRING"), ("customer_nation", "STRING"), ("product_id", "INTEGER"),
                   ("product_brand", "STRING"), ("product_type", "STRING"), ("quantity", "FLOAT"), ("amount", "FLOAT"),
                   ("discount_rate", "FLOAT"), ("order_status", "STRING"), ("order_priority", "STRING"),
                   ("ship_date", "DATE"), ("order_date", "DATE")],
    "orders_wide": [("transaction_id", "INTEGER"), ("customer_id", "INTEGER"), ("customer_name", "STRING"),
                    ("customer_segment", "STRING"), ("customer_nation", "STRING"), ("order_status", "STRING"),
                    ("order_priority", "STRING"), ("order_date", "DATE"), ("total_amount", "FLOAT")],
}
CATALOGUE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
             "embeddings", "pages", "benchmark", "labels", "conversations")
LOAD_TS_SQL = "TIMESTAMP '2024-01-01 00:00:00'"
_MEASURE_RE = "|".join(MEASURE_TERMS)


# ---------------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------------

def _round(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_PROFILE_COLS = ["table_name", "column_name", "ordinal", "logical_type", "total_rows", "non_null_count",
                 "null_count", "null_percentage", "distinct_count", "distinct_percentage"]


def q_column_profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_of(spark, sf_dir, (name,)).column_profile().select(*_PROFILE_COLS)
    return run


def q_numeric_profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = profile_of(spark, sf_dir, (name,)).numeric_profile().select(
            "table_name", "column_name", "total_rows", "min", "max", "mean", "median", "std", "q1", "q3",
            "outlier_count", "outlier_percentage")
        return _round(out, ["min", "max", "mean", "median", "std", "q1", "q3"])
    return run


def q_iqr_outliers(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = profile_of(spark, sf_dir, (name,)).numeric_profile().select(
            "table_name", "column_name", "q1", "q3",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"),
            "outlier_count", "outlier_percentage")
        return _round(out, ["q1", "q3", "lower_bound", "upper_bound"])
    return run


def q_date_profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_of(spark, sf_dir, (name,)).date_profile()
    return run


def q_string_profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_of(spark, sf_dir, (name,)).string_profile()
    return run


def q_top_values(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_of(spark, sf_dir, (name,)).top_values().select(
            "table_name", "column_name", "rank", "value", "count")
    return run


def q_boolean_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_returnflag") == "R").alias("is_returned"))
    return profile_tables(spark, {"lineitem": li}).value_counts().select("column_name", "value", "count")


def q_histogram_extendedprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice").select("bin", "count")


def q_candidate_keys(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The two integers that are NULL where they do not apply are shown as DOUBLE: one representation
        # of "NULL or a number" that every engine and client reads alike.
        return candidate_keys(profile_of(spark, sf_dir, (name,))).select(
            "table_name", "key_rank", "key_type", "column_1", "column_2", "ordinal_1",
            F.col("ordinal_2").cast("double").alias("ordinal_2"), "uniqueness", "distinct_count",
            F.col("null_count").cast("double").alias("null_count"))
    return run


def q_entity_roles(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile_of(spark, sf_dir, (name,)).entity_roles().select(
            "table_name", "column_name", "ordinal", "logical_type", "entity_role", "name_prefix")
    return run


def q_table_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_profile(spark, sf_dir).table_profile().select("table_name", "total_rows", "total_columns", "grain")


def q_table_profile_keys(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from starweave.operators.keys import key_counts

        p = profile_of(spark, sf_dir, (name,))
        return p.table_profile(key_counts(candidate_keys(p))).select(
            "table_name", "total_rows", "total_columns", "grain", "candidate_key_count")
    return run


def q_anomalies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_profile(spark, sf_dir).anomalies()


def q_dimension_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir).model.groups_frame().select("dimension_name", "position", "column_name",
                                                               "is_natural_key")


def q_model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir).model.columns_frame().select(
        "table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk", "references_table",
        "references_column")


def q_model_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir).model.relationships_frame().select(
        "from_table", "from_column", "to_table", "to_column", "relationship_type")


def q_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir).model.summary()


def _date_as_text(df: DataFrame) -> DataFrame:
    """DATE columns in their ISO text form: the value the surrogate keys hash, and one representation
    that reads the same from every engine and client."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "date" else F.col(f.name)
                       for f in df.schema.fields])


def q_split_table(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _date_as_text(modelled(spark, sf_dir).tables[table])
    return run


def q_fk_join_existing_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows against an existing customer dimension (built from the customer table) by natural key."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    dim = customer.select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("DIM_CUSTOMER_SK"))
    fact = wide_input(spark, sf_dir, "orders_wide").select("transaction_id", "customer_id")
    return resolve_fk(fact, dim, ["customer_id"], ["c_custkey"], "DIM_CUSTOMER_SK", "customer_id_FK")


def q_dq_pk_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


def q_dq_pk_check_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.check_pk(li, ["l_orderkey", "l_linenumber"], "lineitem").select(
        "table_name", "check_name", "column_name", "passed", "violation_count", "message")


def q_dq_fk_lineitem_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return quality.check_fk(li, orders, "l_orderkey", "o_orderkey", "lineitem -> orders").select(
        "table_name", "check_name", "column_name", "passed", "violation_count", "message")


def q_dq_fk_orphans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.orphan_keys(docs, labels, "doc_id", "doc_id").select(F.col("key").alias("doc_id"))


def q_dq_nulls_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL counts of every column of every table (every column treated as required)."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in CATALOGUE}
    return _all([quality.null_counts(df, df.columns, t) for t, df in frames.items()])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_dq_types_orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modelled(spark, sf_dir)
    parts = [quality.check_types(spark, m.tables[n], t) for n, t in m.model.tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "check_name", "passed", "violation_count", "message")


def q_dq_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modelled(spark, sf_dir)
    return quality.run_all(m.model, m.tables).select(
        "table_name", "check_name", "column_name", "passed", "violation_count", "message")


def q_row_count_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the loaded split tables against the counts the model implies (fact = input rows,
    dimension = distinct non-null natural keys)."""
    from starweave.plans import load

    db, m = _loaded(spark, sf_dir)
    expected = {}
    for name, t in m.model.tables.items():
        if t.table_type == "FACT":
            n = m.source.agg(F.count(F.lit(1)))
        elif name == "DIM_DATE":
            n = m.source.select(F.explode(F.array(*[F.to_date(F.col(c)) for c in m.model.date_columns])).alias("d")).agg(
                F.count_distinct("d"))
        else:
            n = m.source.agg(F.count_distinct(*[F.col(c) for c in t.natural_key]))
        expected[name] = n.first()[0]
    return load.validate_row_counts(spark, db, expected)


def q_clustering_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = modelled(spark, sf_dir)
    return recommend_clustering(m.model, m.profile)


def q_flatten_events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.from_json("props", "map<string,string>").alias("props"))
    child = flatten_nested(ev, ["event_id"])["props"]
    return child.select("event_id", F.col("props_key").alias("prop_key"), F.col("props_value").alias("prop_value"))


def q_flatten_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a struct that holds an array of orders that hold an array of line numbers: two levels of children."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    nested = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.struct(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("orderkey"), "lines"))).alias("orders")).alias("info"))
    child = flatten_nested(nested, ["custkey"])["info_orders_lines"]
    return child.select("custkey", F.col("info_orders_pos").alias("order_pos"), F.col("pos").alias("line_pos"),
                        F.col("info_orders_lines").alias("linenumber"))


def q_flatten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    child = flatten_nested(emb, ["vec_id"])["embedding"]
    return child.select("vec_id", "pos", F.col("embedding").cast("double").alias("val"))


def q_column_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_profile(spark, sf_dir).column_profile().select(*_PROFILE_COLS)


def q_date_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_profile(spark, sf_dir).date_profile()


def q_entity_roles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_profile(spark, sf_dir).entity_roles().select(
        "table_name", "column_name", "ordinal", "logical_type", "entity_role", "name_prefix")


def q_numeric_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue_profile(spark, sf_dir).numeric_profile().select(
        "table_name", "column_name", "total_rows", "min", "max", "mean", "median", "std", "q1", "q3",
        "outlier_count", "outlier_percentage")
    return _round(out, ["min", "max", "mean", "median", "std", "q1", "q3"])


def q_split_events(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _date_as_text(modelled(spark, sf_dir, "events", order_by="event_id").tables[table])
    return run


def q_model_columns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(spark, sf_dir, "events", order_by="event_id").model.columns_frame().select(
        "table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk", "references_table",
        "references_column")


def q_csv_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``orders`` as CSV (split-table sink), read it back with sniffing, type inference and reject
    handling, and return the typed rows."""
    from starweave.plans import sinks
    from starweave.session import scratch_path
    from starweave.sources import read_csv

    out = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    sinks.write_tables(spark, {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")}, out, fmt="csv").collect()
    back = read_csv(spark, sinks.table_path(out, "orders"))
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                       F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


def q_jsonl_roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.session import scratch_path
    from starweave.sources import read_jsonl

    out = scratch_path(spark, f"jsonl-{uuid.uuid4().hex[:12]}")
    (spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(out))
    back = read_jsonl(spark, out)
    return back.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value",
                       "props")


def q_validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.functions.frames import local_frame
    from starweave.sources import validate_source

    rows = [(t, *validate_source(spark, f"{sf_dir}/{t}.parquet")) for t in CATALOGUE]
    return local_frame(spark, rows, "table_name string, ok boolean, message string")


def _loaded(spark: SparkSession, sf_dir: str):
    """orders_wide split, written and loaded into a fresh audit database by one complete run: (database, modelled)."""
    from starweave.plans import load, sinks
    from starweave.session import scratch_path

    m = modelled(spark, sf_dir)
    tag = uuid.uuid4().hex[:12]
    summary = sinks.write_tables(spark, m.tables, scratch_path(spark, f"split-{tag}")).collect()  # one row per table
    m.paths = {r["table_name"]: r["path"] for r in summary if r["error"] is None}
    m.expected = {r["table_name"]: r["row_count"] for r in summary if r["error"] is None}
    db = f"sw_audit_{tag}"
    load.load_all(spark, m.model, m.paths, "orders_wide", db, expected_rows=m.expected,
                  location=scratch_path(spark, f"warehouse-{tag}"))
    return db, m


def _audited_runs(spark: SparkSession, sf_dir: str) -> str:
    """A complete run, and one that also names a table outside the model (that table fails, the run is PARTIAL)."""
    from starweave.plans import load

    db, m = _loaded(spark, sf_dir)
    missing = {"DIM_UNMODELLED": m.paths["FACT_MAIN"] + "-missing"}
    load.load_all(spark, m.model, {**m.paths, **missing}, "orders_wide", db, expected_rows=m.expected)
    return db


def q_audit_run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drill-down into the failed run of a complete one, a partial one and one in which nothing could be loaded."""
    from starweave.plans import audit, load

    db = _audited_runs(spark, sf_dir)
    load.load_all(spark, modelled(spark, sf_dir).model, {"DIM_NOWHERE": "/nowhere"}, "orders_wide", db)
    detail = audit.run_detail(spark, db, status=audit.FAILED)
    return detail["run"].join(detail["tables"].withColumnRenamed("STATUS", "TABLE_STATUS"), "RUN_ID").select(
        "RUN_ID", "STATUS", "TOTAL_TABLES", "TABLES_LOADED", "TABLES_FAILED", "TABLE_NAME", "TABLE_STATUS", "ROWS_LOADED")


def _lineitem_csv(spark: SparkSession, sf_dir: str) -> str:
    """lineitem as CSV in which quantities of every 40th order are no numbers and every 50th order has a code "7D"."""
    from starweave.plans import sinks
    from starweave.session import scratch_path

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.when(F.col("l_orderkey") % 50 == 0, F.lit("7D")).otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        F.when(F.col("l_orderkey") % 40 == 0, F.lit("many")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("two\nlines")).otherwise("one").alias("note"))
    out = scratch_path(spark, f"lineitem-{uuid.uuid4().hex[:12]}")
    sinks.write_tables(spark, {"lineitem": li}, out, fmt="csv").collect()
    return sinks.table_path(out, "lineitem")


def _csv_loaded(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    from starweave.plans import audit, load
    from starweave.session import scratch_path

    db = f"sw_csv_{uuid.uuid4().hex[:12]}"
    load.create_namespace(spark, db, scratch_path(spark, db))
    audit.ensure_audit_tables(spark, db)
    spark.sql(f"CREATE TABLE {db}.lineitem (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, note STRING) USING parquet")
    result = load.copy_into(spark, _lineitem_csv(spark, sf_dir), db, "lineitem", "csv")
    audit.log_errors(spark, db, 1, "lineitem", result.rejects)
    return db, result


def q_csv_load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows loaded and rejected, by reason, from a CSV file with values that do not fit the table's types."""
    db, result = _csv_loaded(spark, sf_dir)
    good = spark.table(f"{db}.lineitem").agg(F.count(F.lit(1)).alias("rows"), F.count("l_quantity").alias("with_quantity"),
                                             F.count_if(F.col("note").contains("\n")).alias("two_lines"))
    bad = spark.table(f"{db}.INGESTION_ERRORS").groupBy(F.col("ERROR_MESSAGE").alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("ROW_NUMBER").alias("with_quantity"),
        F.count_if(F.col("REJECTED_ROW").contains("\n")).alias("two_lines"))
    return good.select(F.lit("loaded").alias("reason"), "rows", "with_quantity", "two_lines").unionByName(bad)


def q_csv_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error view (its latest 500 entries) over the rejects of the same load."""
    from starweave.plans import audit

    db, _ = _csv_loaded(spark, sf_dir)
    return audit.recent_errors(spark, db).agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("ERROR_ID").alias("ids"),
                                              F.min("TABLE_NAME").alias("table_name"))


def q_csv_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with line breaks and quotes written as CSV and read back."""
    from starweave.plans import sinks
    from starweave.session import scratch_path
    from starweave.sources import read_csv

    out = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    sinks.write_tables(spark, {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}, out, fmt="csv").collect()
    back = read_csv(spark, sinks.table_path(out, "documents"), na_values=("",))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def q_csv_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of customer files in two encodings and two delimiters; the first column has codes like "10D"."""
    from starweave.session import scratch_path
    from starweave.sources import read_csv

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("D")).alias("code"),
        F.concat("c_name", F.lit(" José")).alias("name"), "c_acctbal")
    out = scratch_path(spark, f"mixed-{uuid.uuid4().hex[:12]}")
    for k, (sep, encoding) in enumerate(((",", "UTF-8"), (";", "ISO-8859-1"))):
        c.where(F.col("c_custkey") % 2 == k).write.mode("append").option("header", True).option("sep", sep).option(
            "encoding", encoding).csv(out)
    return read_csv(spark, out).select("c_custkey", "code", "name", "c_acctbal")


def q_json_array_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array document per nation, read back as one table."""
    from starweave.session import scratch_path
    from starweave.sources import read_json

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    docs = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey"))).alias("value"))
    out = scratch_path(spark, f"json-{uuid.uuid4().hex[:12]}")
    docs.write.partitionBy("n").text(out)
    return read_json(spark, out).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                                        F.col("c_nationkey").cast("long").alias("c_nationkey"))


def q_split_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split tables written as CSV and read back with the model's schema: rows per table and the checks' verdicts."""
    from starweave.plans import sinks
    from starweave.session import scratch_path

    m = modelled(spark, sf_dir)
    summary = sinks.write_tables(spark, m.tables, scratch_path(spark, f"split-{uuid.uuid4().hex[:12]}"), fmt="csv").collect()
    back, failed = quality.load_split_tables(spark, m.model, {r["table_name"]: r["path"] for r in summary}, "csv")
    counts = _all([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in back.items()])
    checks = quality.run_all(m.model, back, include_types=True).unionByName(failed)
    bad = checks.groupBy(F.element_at(F.split("table_name", " "), 1).alias("table_name")).agg(F.count_if(~F.col("passed")).alias("failed"))
    return counts.join(bad, "table_name").select("table_name", "rows", "failed")


def q_append_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appended to a table with other column order, one column more and one type wider."""
    from starweave.plans import load
    from starweave.session import scratch_path

    db = f"sw_append_{uuid.uuid4().hex[:12]}"
    load.create_namespace(spark, db, scratch_path(spark, db))
    spark.sql(f"CREATE TABLE {db}.customer (c_name STRING, c_custkey BIGINT, c_note STRING, c_nationkey BIGINT) USING parquet")
    load.append_by_name(spark, spark.read.parquet(f"{sf_dir}/customer.parquet"), db, "customer")
    return spark.table(f"{db}.customer")


def _wide_model_columns(**options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return modelled(spark, sf_dir, **options).model.columns_frame().select(
            "table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk", "references_table",
            "references_column")
    return run


def q_numeric_profile_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of lineitem in which NaN stands for the values of line number 7; NaN counts as missing."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"))
    p = profile_tables(spark, {"lineitem": li})
    out = p.numeric_profile().join(p.column_profile().select("column_name", "null_count", "distinct_count"), "column_name").select(
        "column_name", "total_rows", "null_count", "distinct_count", "min", "max", "mean", "median", "std", "q1", "q3", "outlier_count")
    return _round(out, ["min", "max", "mean", "median", "std", "q1", "q3"])


def q_date_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text in two layouts, with texts that are no dates and missing ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    text = (F.when(F.col("o_orderkey") % 10 == 0, F.lit("soon")).when(F.col("o_orderkey") % 10 == 1, F.lit(None).cast("string"))
            .when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(day.cast("string")))
    return profile_tables(spark, {"orders": o.select(text.alias("order_date"))}).date_profile()


def q_dq_failing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary-key, foreign-key, NULL and value-type checks on frames that violate them, with the first violations."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 5 != 0)
    holes = li.select(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("l_quantity"), "l_suppkey")
    out = _all([quality.check_pk(li, ["l_orderkey"], "lineitem"), quality.check_fk(li, orders, "l_orderkey", "o_orderkey", "lineitem -> orders"),
                quality.check_nulls(holes, ["l_quantity", "l_suppkey"], "lineitem")])
    return out.select("table_name", "check_name", "column_name", "passed", "violation_count", "message",
                      F.array_join("sample", ",").alias("sample"))


def q_dq_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a text column that do not convert to the expected type."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") == 3, F.lit("n/k")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"))
    return quality.value_type_violations(li, {"l_quantity": "double"}, "lineitem")


def q_orphan_sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 least document ids without a label (a top-k report)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.orphan_sample(docs, labels, "doc_id", "doc_id").select(F.col("key").alias("doc_id"))


def q_audit_table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.plans import audit

    db = _audited_runs(spark, sf_dir)
    return audit.recent_status(spark, db).select("STATUS_ID", "RUN_ID", "TABLE_NAME", "STATUS", "ROWS_LOADED",
                                                  "ROWS_EXPECTED")


def q_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.plans import audit

    return audit.summary(spark, _audited_runs(spark, sf_dir))


def q_audit_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.plans import audit

    db = _audited_runs(spark, sf_dir)
    return audit.recent_runs(spark, db).select("RUN_ID", "STATUS", "SOURCE_FILE_NAME", "TOTAL_TABLES",
                                                "TABLES_LOADED", "TABLES_FAILED")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "column_profile_events": q_column_profile("events"),
        "column_profile_orders_wide": q_column_profile("orders_wide"),
        "column_profile_lineitem": q_column_profile("lineitem"),
        "numeric_profile_lineitem": q_numeric_profile("lineitem"),
        "iqr_outliers_lineitem": q_iqr_outliers("lineitem"),
        "iqr_outliers_events": q_iqr_outliers("events"),
        "date_profile_orders": q_date_profile("orders"),
        "date_profile_events": q_date_profile("events"),
        "string_profile_documents": q_string_profile("documents"),
        "top_values_orders_wide": q_top_values("orders_wide"),
        "top_values_documents": q_top_values("documents"),
        "boolean_counts_lineitem": q_boolean_counts_lineitem,
        "histogram_extendedprice": q_histogram_extendedprice,
        "candidate_keys_events": q_candidate_keys("events"),
        "candidate_keys_orders_wide": q_candidate_keys("orders_wide"),
        "entity_roles_orders_wide": q_entity_roles("orders_wide"),
        "entity_roles_events": q_entity_roles("events"),
        "table_profile_all": q_table_profile_all,
        "anomalies_all": q_anomalies_all,
        "table_profile_events": q_table_profile_keys("events"),
        "table_profile_orders_wide": q_table_profile_keys("orders_wide"),
        "dimension_groups_orders_wide": q_dimension_groups,
        "model_columns_orders_wide": q_model_columns,
        "model_relationships_orders_wide": q_model_relationships,
        "model_summary_orders_wide": q_model_summary,
        "dim_customer": q_split_table("DIM_CUSTOMER"),
        "dim_order": q_split_table("DIM_ORDER"),
        "dim_transaction": q_split_table("DIM_TRANSACTION"),
        "dim_date": q_split_table("DIM_DATE"),
        "fact_main": q_split_table("FACT_MAIN"),
        "fk_join_existing_dim": q_fk_join_existing_dim,
        "dq_pk_lineitem": q_dq_pk_lineitem,
        "dq_pk_check_lineitem": q_dq_pk_check_lineitem,
        "dq_fk_lineitem_orders": q_dq_fk_lineitem_orders,
        "dq_fk_orphans_labels": q_dq_fk_orphans_labels,
        "dq_nulls_all": q_dq_nulls_all,
        "dq_types_orders_wide": q_dq_types_orders_wide,
        "dq_run_all": q_dq_run_all,
        "row_count_validation": q_row_count_validation,
        "clustering_recommendation": q_clustering_recommendation,
        "flatten_events_props": q_flatten_events_props,
        "flatten_embeddings": q_flatten_embeddings,
        "column_profile_all": q_column_profile_all,
        "numeric_profile_all": q_numeric_profile_all,
        "date_profile_all": q_date_profile_all,
        "entity_roles_all": q_entity_roles_all,
        "top_values_lineitem": q_top_values("lineitem"),
        "candidate_keys_lineitem": q_candidate_keys("lineitem"),
        "date_profile_lineitem": q_date_profile("lineitem"),
        "string_profile_conversations": q_string_profile("conversations"),
        "string_profile_pages": q_string_profile("pages"),
        "top_values_conversations": q_top_values("conversations"),
        "top_values_pages": q_top_values("pages"),
        "candidate_keys_sales_wide": q_candidate_keys("sales_wide"),
        "entity_roles_sales_wide": q_entity_roles("sales_wide"),
        "candidate_keys_conversations": q_candidate_keys("conversations"),
        "model_columns_events": q_model_columns_events,
        "fact_main_events": q_split_events("FACT_MAIN"),
        "dim_event_events": q_split_events("DIM_EVENT"),
        "dim_user_events": q_split_events("DIM_USER"),
        "dim_date_events": q_split_events("DIM_DATE"),
        "csv_roundtrip_orders": q_csv_roundtrip_orders,
        "jsonl_roundtrip_events": q_jsonl_roundtrip_events,
        "validate_sources": q_validate_sources,
        "audit_table_status": q_audit_table_status,
        "audit_summary": q_audit_summary,
        "audit_recent_runs": q_audit_recent_runs,
        "audit_run_detail": q_audit_run_detail,
        "flatten_order_lines": q_flatten_order_lines,
        "csv_load_rejects": q_csv_load_rejects,
        "csv_recent_errors": q_csv_recent_errors,
        "csv_roundtrip_documents": q_csv_roundtrip_documents,
        "csv_mixed_folder": q_csv_mixed_folder,
        "json_array_customers": q_json_array_customers,
        "split_readback": q_split_readback,
        "append_by_name": q_append_by_name,
        "model_columns_3nf": _wide_model_columns(model_type="3nf"),
        "model_columns_no_date": _wide_model_columns(include_date_dim=False),
        "numeric_profile_nan": q_numeric_profile_nan,
        "date_profile_text": q_date_profile_text,
        "dq_failing_checks": q_dq_failing_checks,
        "dq_value_types": q_dq_value_types,
        "orphan_sample_labels": q_orphan_sample_labels,
    }
    out |= entry_sources.QUERIES
    if llm_queries is not None:
        out |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return out


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: profile → model → split ``orders_wide`` at sf0.001; DQ results with table row counts."""
    m = modelled(spark, SMOKE_DIR)
    results = quality.run_all(m.model, m.tables)
    counts = None
    for name, df in m.tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    return results.join(counts, "table_name", "left").select(
        "table_name", "check_name", "column_name", "passed", "violation_count", "message", "row_count")


# ---------------------------------------------------------------------------------------------------
# Oracle side (DuckDB)
# ---------------------------------------------------------------------------------------------------

def _src(table: str) -> tuple[str, str]:
    """(WITH-clause prefix, relation name)."""
    if table == "orders_wide":
        return f"WITH orders_wide AS ({ORDERS_WIDE_SQL})\n", "orders_wide"
    if table == "sales_wide":
        return f"WITH sales_wide AS ({SALES_WIDE_SQL})\n", "sales_wide"
    return "", table


def _lt(col: str, kind: str) -> str:
    return (f"CASE WHEN regexp_matches(lower('{col}'), '{ID_PATTERN}') THEN 'ID' "
            f"WHEN regexp_matches(lower('{col}'), '{DATE_NAME_PATTERN}') THEN 'DATE' ELSE '{kind}' END")


def _logical(table: str) -> list[tuple[str, str]]:
    out = []
    for c, kind in SCHEMAS[table]:
        lc = c.lower()
        import re
        if re.search(ID_PATTERN, lc):
            out.append((c, "ID"))
        elif re.search(DATE_NAME_PATTERN, lc):
            out.append((c, "DATE"))
        else:
            out.append((c, kind))
    return out


def _profile_branch(table: str, rel: str, i: int, c: str, kind: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, {_lt(c, kind)} AS logical_type, "
        f"count(*) AS total_rows, count(\"{c}\") AS non_null_count, count(*) - count(\"{c}\") AS null_count, "
        f"CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * (count(*) - count(\"{c}\")) / count(*), 2) ELSE 0.0::DOUBLE END AS null_percentage, "
        f"count(DISTINCT \"{c}\") AS distinct_count, "
        f"CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(DISTINCT \"{c}\") / count(*), 2) ELSE 0.0::DOUBLE END AS distinct_percentage "
        f"FROM {rel}"
    )


def sql_column_profile(table: str) -> str:
    w, rel = _src(table)
    return w + "\nUNION ALL\n".join(_profile_branch(table, rel, i + 1, c, k) for i, (c, k) in enumerate(SCHEMAS[table]))


def _numeric_cols(table: str) -> list[str]:
    return [c for c, lt in _logical(table) if lt in ("INTEGER", "FLOAT")]


def _numeric_branch(table: str, rel: str, c: str) -> str:
    x = f"CAST(\"{c}\" AS DOUBLE)"
    return (
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, min({x}) AS min, max({x}) AS max, "
        f"avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, stddev_samp({x}) AS std, "
        f"quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, "
        f"(SELECT count(*) FROM {rel} WHERE {x} < b.lo OR {x} > b.hi) AS outlier_count "
        f"FROM {rel}, (SELECT quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS lo, "
        f"quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS hi FROM {rel}) b "
        f"GROUP BY b.lo, b.hi"
    )


def _numeric_sql(table: str) -> str:
    w, rel = _src(table)
    body = "\nUNION ALL\n".join(_numeric_branch(table, rel, c) for c in _numeric_cols(table))
    return w, body


def sql_numeric_profile(table: str) -> str:
    w, body = _numeric_sql(table)
    return (w + f"SELECT table_name, column_name, total_rows, round(min, 2) AS min, round(max, 2) AS max, "
            f"round(mean, 2) AS mean, round(median, 2) AS median, round(std, 2) AS std, round(q1, 2) AS q1, "
            f"round(q3, 2) AS q3, outlier_count, "
            f"CASE WHEN total_rows > 0 THEN round(outlier_count * 100.0::DOUBLE / total_rows, 2) ELSE 0.0 END AS outlier_percentage "
            f"FROM ({body}) s")


def sql_iqr_outliers(table: str) -> str:
    w, body = _numeric_sql(table)
    return (w + f"SELECT table_name, column_name, round(q1, 2) AS q1, round(q3, 2) AS q3, "
            f"round(q1 - 1.5 * (q3 - q1), 2) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 2) AS upper_bound, outlier_count, "
            f"CASE WHEN total_rows > 0 THEN round(outlier_count * 100.0::DOUBLE / total_rows, 2) ELSE 0.0 END AS outlier_percentage "
            f"FROM ({body}) s")


def sql_date_profile(table: str) -> str:
    w, rel = _src(table)
    cols = [c for c, lt in _logical(table) if lt == "DATE"]
    return w + "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(\"{c}\") AS valid_date_count, "
        f"count(*) - count(\"{c}\") AS invalid_date_count, CAST(min(\"{c}\") AS VARCHAR) AS min_date, "
        f"CAST(max(\"{c}\") AS VARCHAR) AS max_date FROM {rel}" for c in cols)


def sql_string_profile(table: str) -> str:
    w, rel = _src(table)
    cols = [c for c, lt in _logical(table) if lt == "STRING"]
    return w + "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
        f"coalesce(round(avg(length(CAST(\"{c}\" AS VARCHAR))), 2), 0.0) AS avg_length, "
        f"coalesce(CAST(max(length(CAST(\"{c}\" AS VARCHAR))) AS INTEGER), 0) AS max_length FROM {rel}" for c in cols)


def sql_top_values(table: str) -> str:
    w, rel = _src(table)
    cols = [c for c, lt in _logical(table) if lt == "STRING"]
    branches = []
    for c in cols:
        txt = f"CAST(\"{c}\" AS VARCHAR)"
        branches.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(rank AS INTEGER) AS rank, value, count FROM ("
            f"SELECT {txt} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, sha256({txt}) ASC) AS rank "
            f"FROM {rel} WHERE \"{c}\" IS NOT NULL GROUP BY {txt}) WHERE rank <= 10")
    return w + "\nUNION ALL\n".join(branches)


def sql_candidate_keys(table: str) -> str:
    w, rel = _src(table)
    cols = [c for c, _ in SCHEMAS[table]]
    branches = [
        f"SELECT 'single' AS key_type, '{c}' AS column_1, CAST(NULL AS VARCHAR) AS column_2, {i + 1} AS o1, "
        f"CAST(NULL AS INTEGER) AS o2, count(DISTINCT \"{c}\") AS dc, count(*) - count(\"{c}\") AS nc, count(*) AS n FROM {rel}"
        for i, c in enumerate(cols)
    ]
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            branches.append(
                f"SELECT 'composite', '{a}', '{b}', {i + 1}, {j + 1}, count(DISTINCT (\"{a}\", \"{b}\")), "
                f"CAST(NULL AS BIGINT), count(*) FROM {rel}")
    body = "\nUNION ALL\n".join(branches)
    return (w + f"SELECT '{table}' AS table_name, CAST(row_number() OVER (ORDER BY round(dc / n, 4) DESC, "
            f"CASE key_type WHEN 'single' THEN 0 ELSE 1 END, o1, o2) AS INTEGER) AS key_rank, key_type, column_1, column_2, "
            f"CAST(o1 AS INTEGER) AS ordinal_1, CAST(o2 AS DOUBLE) AS ordinal_2, round(dc / n, 4) AS uniqueness, "
            f"dc AS distinct_count, CAST(nc AS DOUBLE) AS null_count FROM ({body}) s WHERE dc >= 0.95 * n")


def _roles_body(table: str) -> str:
    w, rel = _src(table)
    branches = []
    for i, (c, kind) in enumerate(SCHEMAS[table]):
        branches.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST({i + 1} AS INTEGER) AS ordinal, "
            f"{_lt(c, kind)} AS logical_type, count(DISTINCT \"{c}\") AS d, count(*) AS n FROM {rel}")
    return w, "\nUNION ALL\n".join(branches)


def sql_entity_roles(table: str) -> str:
    w, body = _roles_body(table)
    ratio = "CASE WHEN n > 0 THEN d / n ELSE 0.0 END"
    return (w + f"SELECT table_name, column_name, ordinal, logical_type, CASE "
            f"WHEN regexp_matches(lower(column_name), '{ID_PATTERN}') THEN 'ids' "
            f"WHEN logical_type = 'DATE' THEN 'dates' "
            f"WHEN logical_type IN ('INTEGER', 'FLOAT') AND regexp_matches(lower(column_name), '{_MEASURE_RE}') THEN 'facts' "
            f"WHEN logical_type IN ('INTEGER', 'FLOAT') AND {ratio} < 0.1 THEN 'dimensions' "
            f"WHEN logical_type IN ('INTEGER', 'FLOAT') THEN 'facts' "
            f"WHEN logical_type = 'STRING' AND {ratio} < 0.5 THEN 'dimensions' END AS entity_role, "
            f"CASE WHEN contains(column_name, '_') THEN regexp_replace(column_name, '_[^_]*$', '') ELSE 'dimension' END "
            f"AS name_prefix FROM ({body}) s")


def sql_table_profile_all() -> str:
    branches = []
    for t in CATALOGUE:
        names = [c for c, _ in SCHEMAS[t]]
        txn = any("transaction" in c.lower() and "id" in c.lower() for c in names)
        has_date = any("date" in c.lower() or "time" in c.lower() for c in names)
        has_id = any("_id" in c.lower() or c.lower() == "id" for c in names)
        grain = "transaction" if txn else ("event" if has_date and has_id else "row_level")
        branches.append(f"SELECT '{t}' AS table_name, count(*) AS total_rows, CAST({len(names)} AS BIGINT) AS total_columns, "
                        f"'{grain}' AS grain FROM {t}")
    return "\nUNION ALL\n".join(branches)


def sql_table_profile_keys(table: str) -> str:
    w, rel = _src(table)
    keys = sql_candidate_keys(table)
    keys_body = keys[len(w):] if w else keys
    names = [c for c, _ in SCHEMAS[table]]
    txn = any("transaction" in c.lower() and "id" in c.lower() for c in names)
    has_date = any("date" in c.lower() or "time" in c.lower() for c in names)
    has_id = any("_id" in c.lower() or c.lower() == "id" for c in names)
    grain = "transaction" if txn else ("event" if has_date and has_id else "row_level")
    return (w + f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {rel}) AS total_rows, "
            f"CAST({len(names)} AS BIGINT) AS total_columns, '{grain}' AS grain, "
            f"(SELECT count(*) FROM ({keys_body}) k) AS candidate_key_count")


def sql_anomalies_all() -> str:
    prof = "\nUNION ALL\n".join(_profile_branch(t, t, i + 1, c, k) for t in CATALOGUE for i, (c, k) in enumerate(SCHEMAS[t]))
    nums = "\nUNION ALL\n".join(_numeric_branch(t, t, c) for t in CATALOGUE for c in _numeric_cols(t))
    return (
        f"WITH p AS ({prof}), q AS ({nums}) "
        f"SELECT table_name, column_name, 'High null percentage' AS issue, printf('%.2f%%', null_percentage) AS value "
        f"FROM p WHERE null_percentage > 50 "
        f"UNION ALL SELECT table_name, column_name, 'Constant value (no variation)', 'N/A' FROM p WHERE distinct_count = 1 "
        f"UNION ALL SELECT table_name, column_name, 'High outlier percentage', "
        f"printf('%.2f%%', round(outlier_count * 100.0::DOUBLE / total_rows, 2)) FROM q "
        f"WHERE round(outlier_count * 100.0::DOUBLE / total_rows, 2) > 10"
    )


def _hash_sql(cols: list[str]) -> str:
    """Values as text joined by |; a timestamp's fraction, if it has one, is written with six digits."""
    text = {"ts": "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN CAST(ts AS VARCHAR) ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END"}
    parts = (text.get(c, f'CAST("{c}" AS VARCHAR)') for c in cols)
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce({t}, '')" for t in parts) + "))"


_OW_COLS = [c for c, _ in SCHEMAS["orders_wide"]]
_META_SQL = f"{LOAD_TS_SQL} AS LOAD_TS, 'orders_wide' AS SOURCE_FILE_NAME, {{rh}} AS ROW_HASH, 'orders_wide' AS RECORD_SOURCE"


def sql_dim(name: str, nk: str, attrs: list[str]) -> str:
    w, _ = _src("orders_wide")
    attr_sql = "".join(f"arg_min(\"{a}\", transaction_id) AS \"{a}\", " for a in attrs)
    meta = _META_SQL.format(rh=f"arg_min({_hash_sql(_OW_COLS)}, transaction_id)")
    return (w + f"SELECT sha256(CAST(\"{nk}\" AS VARCHAR)) AS {name}_SK, \"{nk}\" AS {nk}_NK, {attr_sql}{meta} "
            f"FROM orders_wide WHERE \"{nk}\" IS NOT NULL GROUP BY \"{nk}\"")


def sql_dim_date() -> str:
    w, _ = _src("orders_wide")
    cal = ("CAST(year(DATE_NK) AS INTEGER) AS YEAR, CAST(quarter(DATE_NK) AS INTEGER) AS QUARTER, "
           "CAST(month(DATE_NK) AS INTEGER) AS MONTH, CAST(day(DATE_NK) AS INTEGER) AS DAY, "
           "CAST(isodow(DATE_NK) AS INTEGER) AS DAY_OF_WEEK, dayname(DATE_NK) AS DAY_NAME, "
           "monthname(DATE_NK) AS MONTH_NAME, isodow(DATE_NK) >= 6 AS IS_WEEKEND")
    rh = ("sha256(concat_ws('|', CAST(DATE_NK AS VARCHAR), CAST(YEAR AS VARCHAR), CAST(QUARTER AS VARCHAR), "
          "CAST(MONTH AS VARCHAR), CAST(DAY AS VARCHAR), CAST(DAY_OF_WEEK AS VARCHAR), DAY_NAME, MONTH_NAME, "
          "CASE WHEN IS_WEEKEND THEN 'True' ELSE 'False' END))")
    return (w + f"SELECT DATE_SK, CAST(DATE_NK AS VARCHAR) AS DATE_NK, YEAR, QUARTER, MONTH, DAY, DAY_OF_WEEK, DAY_NAME, "
            f"MONTH_NAME, IS_WEEKEND, "
            f"{LOAD_TS_SQL} AS LOAD_TS, 'orders_wide' AS SOURCE_FILE_NAME, {rh} AS ROW_HASH, 'orders_wide' AS RECORD_SOURCE "
            f"FROM (SELECT sha256(CAST(DATE_NK AS VARCHAR)) AS DATE_SK, DATE_NK, {cal} FROM "
            f"(SELECT DISTINCT CAST(order_date AS DATE) AS DATE_NK FROM orders_wide WHERE order_date IS NOT NULL) d) c")


def sql_fact_main() -> str:
    w, _ = _src("orders_wide")
    fk = lambda c: f"CASE WHEN \"{c}\" IS NOT NULL THEN sha256(CAST(\"{c}\" AS VARCHAR)) END AS {c}_FK"
    return (w + "SELECT transaction_id, total_amount, "
            "CASE WHEN order_date IS NOT NULL THEN sha256(CAST(CAST(order_date AS DATE) AS VARCHAR)) END AS order_date_FK, "
            f"{fk('customer_id')}, {fk('order_status')}, {fk('transaction_id')}, "
            + _META_SQL.format(rh=_hash_sql(_OW_COLS)) + " FROM orders_wide")


# Expected orders_wide model (fixed: derived by reading the naming and ratio rules; see FIXTURES.md).
_MODEL_COLUMNS = [
    ("FACT_MAIN", 1, "transaction_id", "NUMBER(38,0)", False, True, False, None, None),
    ("FACT_MAIN", 2, "total_amount", "FLOAT", False, False, False, None, None),
    ("FACT_MAIN", 3, "order_date_FK", "TEXT", False, False, True, "DIM_DATE", "DATE_SK"),
    ("FACT_MAIN", 4, "customer_id_FK", "TEXT", False, False, True, "DIM_CUSTOMER", "DIM_CUSTOMER_SK"),
    ("FACT_MAIN", 5, "order_status_FK", "TEXT", False, False, True, "DIM_ORDER", "DIM_ORDER_SK"),
    ("FACT_MAIN", 6, "transaction_id_FK", "TEXT", False, False, True, "DIM_TRANSACTION", "DIM_TRANSACTION_SK"),
    ("DIM_CUSTOMER", 1, "DIM_CUSTOMER_SK", "TEXT", False, True, False, None, None),
    ("DIM_CUSTOMER", 2, "customer_id_NK", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_CUSTOMER", 3, "customer_name", "TEXT", False, False, False, None, None),
    ("DIM_CUSTOMER", 4, "customer_segment", "TEXT", False, False, False, None, None),
    ("DIM_CUSTOMER", 5, "customer_nation", "TEXT", False, False, False, None, None),
    ("DIM_ORDER", 1, "DIM_ORDER_SK", "TEXT", False, True, False, None, None),
    ("DIM_ORDER", 2, "order_status_NK", "TEXT", False, False, False, None, None),
    ("DIM_ORDER", 3, "order_priority", "TEXT", False, False, False, None, None),
    ("DIM_TRANSACTION", 1, "DIM_TRANSACTION_SK", "TEXT", False, True, False, None, None),
    ("DIM_TRANSACTION", 2, "transaction_id_NK", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 1, "DATE_SK", "TEXT", False, True, False, None, None),
    ("DIM_DATE", 2, "DATE_NK", "DATE", False, False, False, None, None),
    ("DIM_DATE", 3, "YEAR", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 4, "QUARTER", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 5, "MONTH", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 6, "DAY", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 7, "DAY_OF_WEEK", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_DATE", 8, "DAY_NAME", "TEXT", False, False, False, None, None),
    ("DIM_DATE", 9, "MONTH_NAME", "TEXT", False, False, False, None, None),
    ("DIM_DATE", 10, "IS_WEEKEND", "BOOLEAN", False, False, False, None, None),
]
_TABLE_WIDTH = {"FACT_MAIN": 6, "DIM_CUSTOMER": 5, "DIM_ORDER": 3, "DIM_TRANSACTION": 2, "DIM_DATE": 10}
_METADATA = [("LOAD_TS", "TIMESTAMP_NTZ", False), ("SOURCE_FILE_NAME", "TEXT", True), ("ROW_HASH", "TEXT", True),
             ("RECORD_SOURCE", "TEXT", True)]


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"CAST({v} AS INTEGER)"
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: list[str]) -> str:
    return "\nUNION ALL\n".join(
        "SELECT " + ", ".join(f"{_lit(v)} AS {n}" for v, n in zip(r, names)) for r in rows)


def sql_model_columns() -> str:
    rows = list(_MODEL_COLUMNS)
    for t, width in _TABLE_WIDTH.items():
        for j, (m, dt, nl) in enumerate(_METADATA):
            rows.append((t, width + j + 1, m, dt, nl, False, False, None, None))
    return _values(rows, ["table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk",
                          "references_table", "references_column"])


def sql_dimension_groups() -> str:
    rows = [("DIM_CUSTOMER", 1, "customer_name", False), ("DIM_CUSTOMER", 2, "customer_segment", False),
            ("DIM_CUSTOMER", 3, "customer_nation", False), ("DIM_CUSTOMER", 4, "customer_id", True),
            ("DIM_ORDER", 1, "order_status", True), ("DIM_ORDER", 2, "order_priority", False),
            ("DIM_TRANSACTION", 1, "transaction_id", True)]
    return _values(rows, ["dimension_name", "position", "column_name", "is_natural_key"])


def sql_model_relationships() -> str:
    rows = [("FACT_MAIN", "order_date_FK", "DIM_DATE", "DATE_SK", "many_to_one"),
            ("FACT_MAIN", "customer_id_FK", "DIM_CUSTOMER", "DIM_CUSTOMER_SK", "many_to_one"),
            ("FACT_MAIN", "order_status_FK", "DIM_ORDER", "DIM_ORDER_SK", "many_to_one"),
            ("FACT_MAIN", "transaction_id_FK", "DIM_TRANSACTION", "DIM_TRANSACTION_SK", "many_to_one")]
    return _values(rows, ["from_table", "from_column", "to_table", "to_column", "relationship_type"])


def sql_model_summary() -> str:
    cols = sum(_TABLE_WIDTH.values()) + 4 * len(_TABLE_WIDTH)
    return (f"SELECT CAST(5 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS fact_tables, CAST(4 AS BIGINT) AS dimension_tables, "
            f"CAST(4 AS BIGINT) AS relationships, CAST({cols} AS BIGINT) AS columns")


def sql_dq_nulls_all() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count(\"{c}\") AS null_count, "
        f"CASE WHEN count(*) > 0 THEN round((count(*) - count(\"{c}\")) * 100.0::DOUBLE / count(*), 2) ELSE 0.0 END "
        f"AS null_percentage FROM {t}" for t in CATALOGUE for c, _ in SCHEMAS[t])


def sql_dq_run_all() -> str:
    w, _ = _src("orders_wide")
    pk = {"FACT_MAIN": "transaction_id", "DIM_CUSTOMER": "DIM_CUSTOMER_SK", "DIM_ORDER": "DIM_ORDER_SK",
          "DIM_TRANSACTION": "DIM_TRANSACTION_SK", "DIM_DATE": "DATE_SK"}
    # Keys of the split tables as SQL over orders_wide (SKs are SHA-256 of the natural key text).
    keysets = {
        "FACT_MAIN": "SELECT transaction_id AS k FROM orders_wide",
        "DIM_CUSTOMER": "SELECT DISTINCT sha256(CAST(customer_id AS VARCHAR)) AS k FROM orders_wide",
        "DIM_ORDER": "SELECT DISTINCT sha256(order_status) AS k FROM orders_wide",
        "DIM_TRANSACTION": "SELECT DISTINCT sha256(CAST(transaction_id AS VARCHAR)) AS k FROM orders_wide",
        "DIM_DATE": "SELECT DISTINCT sha256(CAST(CAST(order_date AS DATE) AS VARCHAR)) AS k FROM orders_wide",
    }
    parts = []
    for t, ks in keysets.items():
        parts.append(
            f"SELECT '{t}' AS table_name, 'primary_key_uniqueness' AS check_name, '{pk[t]}' AS column_name, n = 0 AS passed, "
            f"n AS violation_count, CASE WHEN n > 0 THEN printf('Found %d duplicate primary key rows', n) "
            f"ELSE 'Primary key is unique' END AS message FROM (SELECT coalesce(sum(c), 0)::BIGINT AS n FROM "
            f"(SELECT k, count(*) AS c FROM ({ks}) GROUP BY k HAVING count(*) > 1))")
        parts.append(
            f"SELECT '{t}', 'null_constraints', CAST(NULL AS VARCHAR), TRUE, CAST(0 AS BIGINT), "
            f"'All required columns have no nulls'")
    fks = [("DIM_DATE", "order_date_FK", "sha256(CAST(CAST(order_date AS DATE) AS VARCHAR))"),
           ("DIM_CUSTOMER", "customer_id_FK", "sha256(CAST(customer_id AS VARCHAR))"),
           ("DIM_ORDER", "order_status_FK", "sha256(order_status)"),
           ("DIM_TRANSACTION", "transaction_id_FK", "sha256(CAST(transaction_id AS VARCHAR))")]
    for dim, col, expr in fks:
        parts.append(
            f"SELECT 'FACT_MAIN -> {dim}', 'foreign_key_integrity', '{col}', n = 0, n, "
            f"CASE WHEN n > 0 THEN printf('Found %d orphaned foreign keys', n) ELSE 'All foreign keys valid' END "
            f"FROM (SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT {expr} AS k FROM orders_wide) f "
            f"WHERE k NOT IN ({keysets[dim]}))")
    return w + "\nUNION ALL\n".join(parts)


def sql_row_count_validation() -> str:
    w, _ = _src("orders_wide")
    exp = {"FACT_MAIN": "count(*)", "DIM_CUSTOMER": "count(DISTINCT customer_id)", "DIM_ORDER": "count(DISTINCT order_status)",
           "DIM_TRANSACTION": "count(DISTINCT transaction_id)", "DIM_DATE": "count(DISTINCT CAST(order_date AS DATE))"}
    return w + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, {e} AS expected, {e} AS actual, CAST(0 AS BIGINT) AS difference, TRUE AS passed "
        f"FROM orders_wide" for t, e in exp.items())


def sql_clustering_recommendation() -> str:
    w, _ = _src("orders_wide")
    return (w + "SELECT table_name, CAST(row_number() OVER (ORDER BY kind_rank, distinct_count, column_name) AS INTEGER) "
            "AS cluster_rank, column_name, source_column, distinct_count, reason FROM ("
            "SELECT 'FACT_MAIN' AS table_name, 'order_date_FK' AS column_name, 'order_date' AS source_column, 0 AS kind_rank, "
            "count(DISTINCT order_date) AS distinct_count, 'date' AS reason FROM orders_wide UNION ALL "
            "SELECT 'FACT_MAIN', 'customer_id_FK', 'customer_id', 1, count(DISTINCT customer_id), 'foreign key' FROM orders_wide "
            "UNION ALL SELECT 'FACT_MAIN', 'order_status_FK', 'order_status', 1, count(DISTINCT order_status), 'foreign key' "
            "FROM orders_wide UNION ALL SELECT 'FACT_MAIN', 'transaction_id_FK', 'transaction_id', 1, "
            "count(DISTINCT transaction_id), 'foreign key' FROM orders_wide) c")


_SPLIT_COUNTS = {
    "DIM_CUSTOMER": "count(DISTINCT customer_id)", "DIM_ORDER": "count(DISTINCT order_status)",
    "DIM_TRANSACTION": "count(DISTINCT transaction_id)", "DIM_DATE": "count(DISTINCT CAST(order_date AS DATE))",
    "FACT_MAIN": "count(*)",
}


def sql_audit_table_status() -> str:
    w, _ = _src("orders_wide")
    parts = []
    for run in (1, 2):
        for i, (t, e) in enumerate(_SPLIT_COUNTS.items()):
            sid = (run - 1) * 5 + i + 1
            parts.append(f"SELECT CAST({sid} AS BIGINT) AS STATUS_ID, CAST({run} AS BIGINT) AS RUN_ID, '{t}' AS TABLE_NAME, "
                         f"'SUCCESS' AS STATUS, {e} AS ROWS_LOADED, {e} AS ROWS_EXPECTED FROM orders_wide")
    parts.append("SELECT CAST(11 AS BIGINT), CAST(2 AS BIGINT), 'DIM_UNMODELLED', 'FAILED', CAST(0 AS BIGINT), "
                 "CAST(0 AS BIGINT)")
    return w + "\nUNION ALL\n".join(parts)


def sql_audit_summary() -> str:
    w, _ = _src("orders_wide")
    total = " + ".join(_SPLIT_COUNTS.values())
    return (w + f"SELECT 'SUCCESS' AS STATUS, CAST(1 AS BIGINT) AS runs, CAST(5 AS BIGINT) AS tables_loaded, "
            f"CAST(5 AS BIGINT) AS total_tables, {total} AS rows_loaded FROM orders_wide UNION ALL "
            f"SELECT 'PARTIAL', CAST(1 AS BIGINT), CAST(5 AS BIGINT), CAST(6 AS BIGINT), {total} FROM orders_wide")


_EV_COLS = [c for c, _ in SCHEMAS["events"]]
_EV_META = f"{LOAD_TS_SQL} AS LOAD_TS, 'events' AS SOURCE_FILE_NAME, {{rh}} AS ROW_HASH, 'events' AS RECORD_SOURCE"


def sql_events_fact() -> str:
    fk = lambda c: f"CASE WHEN \"{c}\" IS NOT NULL THEN sha256(CAST(\"{c}\" AS VARCHAR)) END AS {c}_FK"
    return ("SELECT event_id, value, CASE WHEN ts IS NOT NULL THEN sha256(CAST(CAST(ts AS DATE) AS VARCHAR)) END AS ts_FK, "
            f"{fk('event_id')}, {fk('props')}, {fk('user_id')}, " + _EV_META.format(rh=_hash_sql(_EV_COLS)) + " FROM events")


def sql_events_dim(name: str, nk: str, attrs: list[str]) -> str:
    attr_sql = "".join(f"arg_min(\"{a}\", event_id) AS \"{a}\", " for a in attrs)
    meta = _EV_META.format(rh=f"arg_min({_hash_sql(_EV_COLS)}, event_id)")
    return (f"SELECT sha256(CAST(\"{nk}\" AS VARCHAR)) AS {name}_SK, \"{nk}\" AS {nk}_NK, {attr_sql}{meta} "
            f"FROM events WHERE \"{nk}\" IS NOT NULL GROUP BY \"{nk}\"")


def sql_events_dim_date() -> str:
    return sql_dim_date().replace(f"WITH orders_wide AS ({ORDERS_WIDE_SQL})\n", "").replace(
        "CAST(order_date AS DATE) AS DATE_NK FROM orders_wide WHERE order_date IS NOT NULL",
        "CAST(ts AS DATE) AS DATE_NK FROM events WHERE ts IS NOT NULL").replace("'orders_wide'", "'events'")


# Expected events model (fixed: derived by reading the rules; FIXTURES.md F4).
_EVENTS_MODEL = [
    ("FACT_MAIN", 1, "event_id", "NUMBER(38,0)", False, True, False, None, None),
    ("FACT_MAIN", 2, "value", "FLOAT", False, False, False, None, None),
    ("FACT_MAIN", 3, "ts_FK", "TEXT", False, False, True, "DIM_DATE", "DATE_SK"),
    ("FACT_MAIN", 4, "event_id_FK", "TEXT", False, False, True, "DIM_EVENT", "DIM_EVENT_SK"),
    ("FACT_MAIN", 5, "props_FK", "TEXT", False, False, True, "DIM_DIMENSION", "DIM_DIMENSION_SK"),
    ("FACT_MAIN", 6, "user_id_FK", "TEXT", False, False, True, "DIM_USER", "DIM_USER_SK"),
    ("DIM_EVENT", 1, "DIM_EVENT_SK", "TEXT", False, True, False, None, None),
    ("DIM_EVENT", 2, "event_id_NK", "NUMBER(38,0)", False, False, False, None, None),
    ("DIM_EVENT", 3, "event_type", "TEXT", False, False, False, None, None),
    ("DIM_DIMENSION", 1, "DIM_DIMENSION_SK", "TEXT", False, True, False, None, None),
    ("DIM_DIMENSION", 2, "props_NK", "TEXT", False, False, False, None, None),
    ("DIM_USER", 1, "DIM_USER_SK", "TEXT", False, True, False, None, None),
    ("DIM_USER", 2, "user_id_NK", "NUMBER(38,0)", False, False, False, None, None),
] + [r for r in _MODEL_COLUMNS if r[0] == "DIM_DATE"]
_EVENTS_WIDTH = {"FACT_MAIN": 6, "DIM_EVENT": 3, "DIM_DIMENSION": 2, "DIM_USER": 2, "DIM_DATE": 10}


def sql_model_columns_events() -> str:
    rows = list(_EVENTS_MODEL)
    for t, width in _EVENTS_WIDTH.items():
        for j, (m, dt, nl) in enumerate(_METADATA):
            rows.append((t, width + j + 1, m, dt, nl, False, False, None, None))
    return _values(rows, ["table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk",
                          "references_table", "references_column"])


def sql_column_profile_all() -> str:
    return "\nUNION ALL\n".join(_profile_branch(t, t, i + 1, c, k) for t in CATALOGUE for i, (c, k) in enumerate(SCHEMAS[t]))


def sql_numeric_profile_all() -> str:
    body = "\nUNION ALL\n".join(_numeric_branch(t, t, c) for t in CATALOGUE for c in _numeric_cols(t))
    return (f"SELECT table_name, column_name, total_rows, round(min, 2) AS min, round(max, 2) AS max, "
            f"round(mean, 2) AS mean, round(median, 2) AS median, round(std, 2) AS std, round(q1, 2) AS q1, "
            f"round(q3, 2) AS q3, outlier_count, "
            f"CASE WHEN total_rows > 0 THEN round(outlier_count * 100.0::DOUBLE / total_rows, 2) ELSE 0.0 END AS outlier_percentage "
            f"FROM ({body}) s")


_MODEL_NAMES = ["table_name", "column_order", "column_name", "data_type", "nullable", "is_pk", "is_fk", "references_table",
                "references_column"]


def _with_metadata(rows: list[tuple]) -> str:
    """Model rows, each table followed by the four metadata columns."""
    out = list(rows)
    for t in dict.fromkeys(r[0] for r in rows):
        width = sum(r[0] == t for r in rows)
        out += [(t, width + j + 1, m, dt, nl, False, False, None, None) for j, (m, dt, nl) in enumerate(_METADATA)]
    return _values(out, _MODEL_NAMES)


def sql_model_columns_3nf() -> str:
    """3NF: one main table with the best key first, then every other column in the order of the input; no fact."""
    types = {"INTEGER": "NUMBER(38,0)", "FLOAT": "FLOAT", "STRING": "TEXT", "DATE": "TIMESTAMP_NTZ"}
    rest = [(c, k) for c, k in SCHEMAS["orders_wide"] if c != "transaction_id"]
    rows = [("MAIN_TABLE", 1, "transaction_id", "NUMBER(38,0)", False, True, False, None, None)]
    rows += [("MAIN_TABLE", i + 2, c, types[k], False, False, False, None, None) for i, (c, k) in enumerate(rest)]
    return _with_metadata(rows + [r for r in _MODEL_COLUMNS if r[0] == "DIM_DATE"])


def sql_model_columns_no_date() -> str:
    """Without the date dimension neither its table nor the fact's key to it exists."""
    kept = [r for r in _MODEL_COLUMNS if r[0] != "DIM_DATE" and r[7] != "DIM_DATE"]
    order: dict[str, int] = {}
    rows = []
    for r in kept:
        order[r[0]] = order.get(r[0], 0) + 1
        rows.append((r[0], order[r[0]], *r[2:]))
    return _with_metadata(rows)


_NEW_ORACLES = {
    "audit_run_detail": (
        "SELECT CAST(3 AS BIGINT) AS RUN_ID, 'FAILED' AS STATUS, CAST(1 AS BIGINT) AS TOTAL_TABLES, CAST(0 AS BIGINT) AS TABLES_LOADED, "
        "CAST(1 AS BIGINT) AS TABLES_FAILED, 'DIM_NOWHERE' AS TABLE_NAME, 'FAILED' AS TABLE_STATUS, CAST(0 AS BIGINT) AS ROWS_LOADED"),
    "flatten_order_lines": (
        "WITH o AS (SELECT o_custkey AS custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) "
        "AS order_pos FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) "
        "SELECT custkey, order_pos, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS line_pos, "
        "l_linenumber AS linenumber FROM o JOIN lineitem ON l_orderkey = o_orderkey"),
    "csv_load_rejects": (
        "SELECT reason, count(*) AS rows, count(*) AS with_quantity, count(*) FILTER (l_orderkey % 3 = 0) AS two_lines FROM ("
        "SELECT l_orderkey, CASE WHEN l_orderkey % 40 <> 0 AND l_orderkey % 50 <> 0 THEN 'loaded' ELSE 'cannot convert: ' || "
        "concat_ws(', ', CASE WHEN l_orderkey % 50 = 0 THEN 'l_linenumber' END, CASE WHEN l_orderkey % 40 = 0 THEN 'l_quantity' END) END AS reason "
        "FROM lineitem) GROUP BY reason"),
    "csv_recent_errors": (
        "SELECT least(count(*), 500) AS shown, least(count(*), 500) AS ids, 'lineitem' AS table_name FROM lineitem "
        "WHERE l_orderkey % 40 = 0 OR l_orderkey % 50 = 0"),
    "csv_roundtrip_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_mixed_folder": (
        "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CAST(c_custkey AS VARCHAR) || 'D' AS code, c_name || ' José' AS name, c_acctbal "
        "FROM customer"),
    "json_array_customers": (
        "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer"),
    "append_by_name": (
        "SELECT c_name, CAST(c_custkey AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_note, CAST(c_nationkey AS BIGINT) AS c_nationkey "
        "FROM customer"),
    "numeric_profile_nan": (
        "WITH v AS (SELECT CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS DOUBLE) END AS x FROM lineitem), "
        "q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v) "
        "SELECT 'l_quantity' AS column_name, count(*) AS total_rows, count(*) - count(x) AS null_count, count(DISTINCT x) AS distinct_count, "
        "round(min(x), 2) AS min, round(max(x), 2) AS max, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 2) AS median, "
        "round(stddev_samp(x), 2) AS std, round(any_value(q1), 2) AS q1, round(any_value(q3), 2) AS q3, "
        "count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM v, q"),
    "date_profile_text": (
        "SELECT 'orders' AS table_name, 'order_date' AS column_name, count(*) FILTER (o_orderkey % 10 > 1) AS valid_date_count, "
        "count(*) FILTER (o_orderkey % 10 <= 1) AS invalid_date_count, "
        "CAST(CAST(min(o_orderdate) FILTER (o_orderkey % 10 > 1) AS TIMESTAMP) AS VARCHAR) AS min_date, "
        "CAST(CAST(max(o_orderdate) FILTER (o_orderkey % 10 > 1) AS TIMESTAMP) AS VARCHAR) AS max_date FROM orders"),
    "dq_failing_checks": (
        "WITH d AS (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 1), "
        "f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)), "
        "n AS (SELECT count(*) AS c FROM lineitem WHERE l_linenumber <= 1) "
        "SELECT 'lineitem' AS table_name, 'primary_key_uniqueness' AS check_name, 'l_orderkey' AS column_name, false AS passed, "
        "CAST(sum(c) AS BIGINT) AS violation_count, printf('Found %d duplicate primary key rows', CAST(sum(c) AS BIGINT)) AS message, "
        "(SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT CAST(k AS VARCHAR) AS t FROM d ORDER BY t LIMIT 10)) AS sample FROM d "
        "UNION ALL SELECT 'lineitem -> orders', 'foreign_key_integrity', 'l_orderkey', false, count(*), "
        "printf('Found %d orphaned foreign keys', count(*)), "
        "(SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT CAST(k AS VARCHAR) AS t FROM f ORDER BY t LIMIT 10)) FROM f "
        "UNION ALL SELECT 'lineitem', 'null_constraints', NULL, false, c, 'Found nulls in 1 required columns', 'l_quantity: ' || c FROM n"),
    "dq_value_types": (
        "SELECT 'lineitem' AS table_name, 'l_quantity' AS column_name, 'double' AS expected, count(*) FILTER (l_linenumber = 3) AS failed_count, "
        "round(count(*) FILTER (l_linenumber = 3) * 100.0::DOUBLE / count(*), 2) AS failed_percentage FROM lineitem"),
    "orphan_sample_labels": (
        "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 100"),
}


def sql_split_readback() -> str:
    w, _ = _src("orders_wide")
    return w + "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, {e} AS rows, CAST(0 AS BIGINT) AS failed FROM orders_wide"
                                     for t, e in _SPLIT_COUNTS.items())


def oracle_sql() -> dict[str, str]:
    out = {
        "column_profile_events": sql_column_profile("events"),
        "column_profile_orders_wide": sql_column_profile("orders_wide"),
        "column_profile_lineitem": sql_column_profile("lineitem"),
        "numeric_profile_lineitem": sql_numeric_profile("lineitem"),
        "iqr_outliers_lineitem": sql_iqr_outliers("lineitem"),
        "iqr_outliers_events": sql_iqr_outliers("events"),
        "date_profile_orders": sql_date_profile("orders"),
        "date_profile_events": sql_date_profile("events"),
        "string_profile_documents": sql_string_profile("documents"),
        "top_values_orders_wide": sql_top_values("orders_wide"),
        "top_values_documents": sql_top_values("documents"),
        "boolean_counts_lineitem": (
            "SELECT 'is_returned' AS column_name, CAST(l_returnflag = 'R' AS VARCHAR) AS value, count(*) AS count "
            "FROM lineitem GROUP BY 2"),
        "histogram_extendedprice": (
            "WITH v AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL), "
            "r AS (SELECT min(x) AS lo, max(x) AS hi FROM v) "
            "SELECT CASE WHEN hi = lo THEN CAST(1 AS BIGINT) ELSE least(CAST(floor(50.0::DOUBLE * (x - lo) / (hi - lo)) AS BIGINT) + 1, 50) END "
            "AS bin, count(*) AS count FROM v, r GROUP BY 1"),
        "candidate_keys_events": sql_candidate_keys("events"),
        "candidate_keys_orders_wide": sql_candidate_keys("orders_wide"),
        "entity_roles_orders_wide": sql_entity_roles("orders_wide"),
        "entity_roles_events": sql_entity_roles("events"),
        "table_profile_all": sql_table_profile_all(),
        "anomalies_all": sql_anomalies_all(),
        "table_profile_events": sql_table_profile_keys("events"),
        "table_profile_orders_wide": sql_table_profile_keys("orders_wide"),
        "dimension_groups_orders_wide": sql_dimension_groups(),
        "model_columns_orders_wide": sql_model_columns(),
        "model_relationships_orders_wide": sql_model_relationships(),
        "model_summary_orders_wide": sql_model_summary(),
        "dim_customer": sql_dim("DIM_CUSTOMER", "customer_id", ["customer_name", "customer_segment", "customer_nation"]),
        "dim_order": sql_dim("DIM_ORDER", "order_status", ["order_priority"]),
        "dim_transaction": sql_dim("DIM_TRANSACTION", "transaction_id", []),
        "dim_date": sql_dim_date(),
        "fact_main": sql_fact_main(),
        "fk_join_existing_dim": (
            f"WITH orders_wide AS ({ORDERS_WIDE_SQL}) SELECT w.transaction_id, w.customer_id, "
            "sha256(CAST(c.c_custkey AS VARCHAR)) AS customer_id_FK FROM orders_wide w "
            "LEFT JOIN customer c ON w.customer_id = c.c_custkey"),
        "dq_pk_lineitem": (
            "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY l_orderkey, l_linenumber "
            "HAVING count(*) > 1"),
        "dq_pk_check_lineitem": (
            "SELECT 'lineitem' AS table_name, 'primary_key_uniqueness' AS check_name, 'l_orderkey,l_linenumber' AS column_name, "
            "n = 0 AS passed, n AS violation_count, CASE WHEN n > 0 THEN printf('Found %d duplicate primary key rows', n) "
            "ELSE 'Primary key is unique' END AS message FROM (SELECT coalesce(sum(c), 0)::BIGINT AS n FROM "
            "(SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"),
        "dq_fk_lineitem_orders": (
            "SELECT 'lineitem -> orders' AS table_name, 'foreign_key_integrity' AS check_name, 'l_orderkey' AS column_name, "
            "n = 0 AS passed, n AS violation_count, CASE WHEN n > 0 THEN printf('Found %d orphaned foreign keys', n) "
            "ELSE 'All foreign keys valid' END AS message FROM (SELECT count(*)::BIGINT AS n FROM "
            "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL) f "
            "WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.l_orderkey))"),
        "dq_fk_orphans_labels": (
            "SELECT DISTINCT d.doc_id FROM documents d WHERE d.doc_id IS NOT NULL AND "
            "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
        "dq_nulls_all": sql_dq_nulls_all(),
        "dq_types_orders_wide": _values(
            [(t, "data_types", True, 0, "All columns match expected types") for t in _TABLE_WIDTH],
            ["table_name", "check_name", "passed", "violation_count", "message"]).replace(
            "CAST(0 AS INTEGER) AS violation_count", "CAST(0 AS BIGINT) AS violation_count"),
        "dq_run_all": sql_dq_run_all(),
        "row_count_validation": sql_row_count_validation(),
        "clustering_recommendation": sql_clustering_recommendation(),
        "flatten_events_props": (
            "SELECT e.event_id, j.key AS prop_key, CAST(j.value AS VARCHAR) AS prop_value "
            "FROM events e, json_each(e.props) j"),
        "flatten_embeddings": (
            "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, "
            "CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings"),
        "column_profile_all": sql_column_profile_all(),
        "numeric_profile_all": sql_numeric_profile_all(),
        "date_profile_all": "\nUNION ALL\n".join(
            sql_date_profile(t) for t in CATALOGUE if any(lt == "DATE" for _, lt in _logical(t))),
        "entity_roles_all": "\nUNION ALL\n".join(f"SELECT * FROM ({sql_entity_roles(t)})" for t in CATALOGUE),
        "top_values_lineitem": sql_top_values("lineitem"),
        "candidate_keys_lineitem": sql_candidate_keys("lineitem"),
        "date_profile_lineitem": sql_date_profile("lineitem"),
        "string_profile_conversations": sql_string_profile("conversations"),
        "string_profile_pages": sql_string_profile("pages"),
        "top_values_conversations": sql_top_values("conversations"),
        "top_values_pages": sql_top_values("pages"),
        "candidate_keys_sales_wide": sql_candidate_keys("sales_wide"),
        "entity_roles_sales_wide": sql_entity_roles("sales_wide"),
        "candidate_keys_conversations": sql_candidate_keys("conversations"),
        "model_columns_events": sql_model_columns_events(),
        "fact_main_events": sql_events_fact(),
        "dim_event_events": sql_events_dim("DIM_EVENT", "event_id", ["event_type"]),
        "dim_user_events": sql_events_dim("DIM_USER", "user_id", []),
        "dim_date_events": sql_events_dim_date(),
        "csv_roundtrip_orders": (
            "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, "
            "o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"),
        "jsonl_roundtrip_events": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
        "validate_sources": _values([(t, True, None) for t in CATALOGUE], ["table_name", "ok", "message"]),
        "audit_table_status": sql_audit_table_status(),
        "audit_summary": sql_audit_summary(),
        "audit_recent_runs": (
            "SELECT CAST(2 AS BIGINT) AS RUN_ID, 'PARTIAL' AS STATUS, 'orders_wide' AS SOURCE_FILE_NAME, "
            "CAST(6 AS BIGINT) AS TOTAL_TABLES, CAST(5 AS BIGINT) AS TABLES_LOADED, CAST(1 AS BIGINT) AS TABLES_FAILED "
            "UNION ALL SELECT 1, 'SUCCESS', 'orders_wide', 5, 5, 0"),
    }
    out |= _NEW_ORACLES | {"model_columns_3nf": sql_model_columns_3nf(), "model_columns_no_date": sql_model_columns_no_date(),
                           "split_readback": sql_split_readback()} | entry_sources.oracles(ORDERS_WIDE_SQL)
    if llm_queries is not None:
        out |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
