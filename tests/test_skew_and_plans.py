"""A key holding a third of all rows must not change results, and the plans must keep their shape:
partial aggregation before every shuffle, no shuffle on the fact side, top-k limited before the shuffle."""

import datetime as dt
import math
import random
import warnings

import pandas as pd
from pyspark.sql import functions as F

from starweave.operators.keys import candidate_keys
from starweave.operators.model import ModelColumn, ModelTable, infer_model
from starweave.operators.profile import profile_table, typed_frequencies
from starweave.operators.quality import duplicate_keys, orphan_keys
from starweave.operators.split import SplitContext, build_dimension, row_hash, split, with_order, with_row_hash

TS = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed(spark, n=3000):
    rows = [(i, 7 if i % 3 == 0 else i % 50, f"name{7 if i % 3 == 0 else i % 50}", float(i % 97), "A" if i % 2 else "B")
            for i in range(n)]
    return spark.createDataFrame(rows, "sale_id long, customer_id long, customer_name string, sales_amount double, "
                                       "store_type string").repartition(6), rows


def test_hot_key_results(spark):
    df, rows = _skewed(spark)
    pdf = pd.DataFrame(rows, columns=["sale_id", "customer_id", "customer_name", "sales_amount", "store_type"])
    p = profile_table(df, "s")
    top = p.top_values().where("column_name = 'customer_name'").orderBy("rank").first()
    assert (top["value"], top["count"]) == ("name7", int((pdf["customer_name"] == "name7").sum()))
    num = {r["column_name"]: r for r in p.numeric_profile().collect()}
    assert num["sales_amount"]["median"] == pdf["sales_amount"].median()
    dup = {r["customer_id"]: r["row_count"] for r in duplicate_keys(df, ["customer_id"]).collect()}
    assert dup[7] == int((pdf["customer_id"] == 7).sum())
    m = infer_model(p, candidate_keys(p), "s")
    tabs = split(df, m, "s", order_by="sale_id", load_ts=TS)
    dim = tabs["DIM_CUSTOMER"]
    assert dim.count() == pdf["customer_id"].nunique()
    assert tabs["FACT_MAIN"].count() == len(rows)
    assert orphan_keys(tabs["FACT_MAIN"], dim, "customer_id_FK", "DIM_CUSTOMER_SK").count() == 0


def test_plan_shapes(spark):
    df, _ = _skewed(spark)
    p = profile_table(df, "s")
    m = infer_model(p, candidate_keys(p), "s")
    tabs = split(df, m, "s", order_by="sale_id", load_ts=TS)
    tabs["DIM_CUSTOMER"].collect()
    dim_plan = _plan(tabs["DIM_CUSTOMER"]).split("== Initial Plan ==")[0]
    assert "partial_min" in dim_plan                         # hot natural key collapsed map-side
    assert "HashAggregate" in dim_plan and "SortAggregate" not in dim_plan and "Sort [" not in dim_plan
    fact_plan = _plan(tabs["FACT_MAIN"])
    assert "Exchange" not in fact_plan and "Join" not in fact_plan  # FKs are computed inline
    freq_plan = _plan(typed_frequencies(p.tables))
    assert "partial_count" in freq_plan
    top_plan = _plan(p.top_value_keys())
    assert "WindowGroupLimit" in top_plan and "Partial" in top_plan
    dup_plan = _plan(duplicate_keys(df, ["customer_id"]))
    assert "partial_count" in dup_plan


def test_scan_reads_only_needed_columns(spark, tmpdir_path):
    df, _ = _skewed(spark)
    path = tmpdir_path + "/skewed"
    df.write.parquet(path)
    from starweave.operators.profile import string_profile

    sp = string_profile(spark.read.parquet(path), ["store_type"])
    plan = _plan(sp)
    assert "ReadSchema: struct<store_type:string>" in plan


def test_first_row_rule(spark):
    """The first row of a key by each kind of order, NULL first, ties by the row's hash; equal rows count once."""
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3]), rng.choice([None, *range(5)]), rng.choice([None, "b", "a", ""]),
             rng.choice([None, dt.date(1960, 1, 2), dt.date(2024, 1, 1)]), rng.choice([-0.5, float("nan"), 2.0, None]),
             f"n{rng.randrange(40)}") for _ in range(400)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "cust_id int, num long, txt string, day date, amount double, cust_name string").repartition(7)
    hashed = {r[:-1]: r[-1] for r in map(tuple, with_row_hash(df.withColumn("amount", F.col("amount").cast("string"))).collect())}
    assert len(hashed) == len({(*r[:4], str(r[4]), r[5]) for r in rows})
    columns = [ModelColumn("cust_name", "STRING", True, "attribute", "cust_name")]
    table = ModelTable("DIM_CUST", "DIM", columns, ["DIM_CUST_SK"], natural_key=["cust_id"])
    whole = df.select("*", row_hash(df).alias("h")).collect()
    null_first = lambda v: (v is not None, isinstance(v, float) and math.isnan(v), v)
    for order in (["num"], ["day"], ["txt"], ["num", "txt"], ["amount"], []):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            out = build_dimension(with_order(df, order), table, SplitContext("s", TS)).collect()
        best = {}
        for r in whole:
            if r["cust_id"] is not None:
                k = (*[null_first(r[c]) if r[c] is not None else (False,) for c in order], r["h"])
                best[r["cust_id"]] = min(best.get(r["cust_id"], (k, r)), (k, r), key=lambda t: t[0])
        assert {r["cust_id_NK"]: (r["cust_name"], r["ROW_HASH"]) for r in out} == {
            c: (r["cust_name"], r["h"]) for c, (_, r) in best.items()}
        assert len(out) == len(best)
