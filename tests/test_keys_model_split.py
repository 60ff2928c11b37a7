import datetime as dt

from pyspark.sql import functions as F

from starweave.operators.keys import candidate_keys
from starweave.operators.model import infer_model, group_dimensions
from starweave.operators.profile import profile_table
from starweave.operators.quality import check_fk, check_pk, duplicate_keys, null_violations, orphan_keys, run_all
from starweave.operators.split import split

TS = dt.datetime(2024, 1, 1)


def test_pair_keys_keep_separator_collisions_apart(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 1)] + [(f"k{i}", "z", 1) for i in range(38)],
                               "x string, y string, const long")
    keys = candidate_keys(profile_table(df)).collect()
    pair = [k for k in keys if k["key_type"] == "composite" and {k["column_1"], k["column_2"]} == {"x", "y"}]
    assert pair and pair[0]["distinct_count"] == 40
    assert not [k for k in keys if k["column_1"] == "const" and k["column_2"] is None]


def test_pairs_count_null_as_value(spark):
    rows = [(i % 20, None if i < 20 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b long")
    keys = candidate_keys(profile_table(df), min_uniqueness=0.5).collect()
    pair = [k for k in keys if k["key_type"] == "composite"][0]
    expected = len({(a, b) for a, b in rows})
    assert pair["distinct_count"] == expected


def test_reference_sample_is_3nf_with_date_dimension(spark):
    df = spark.createDataFrame(
        [(1, 101, 201, 99.99, 2, "2024-01-15"), (2, 102, 202, 149.50, 1, "2024-01-16")],
        "transaction_id long, customer_id long, product_id long, amount double, quantity long, transaction_date string")
    p = profile_table(df, "sample")
    m = infer_model(p, candidate_keys(p), "sample")
    assert m.model_type == "3nf" and m.grain == "transaction"
    assert list(m.tables) == ["MAIN_TABLE", "DIM_DATE"]
    assert m.tables["MAIN_TABLE"].primary_key == ["transaction_id"]
    tabs = split(df, m, "sample.csv", order_by="transaction_id", load_ts=TS)
    assert tabs["MAIN_TABLE"].count() == 2 and tabs["DIM_DATE"].count() == 2


def test_group_dimensions_order_and_new_groups():
    groups = group_dimensions(["customer_name", "customer_segment", "order_status", "region"],
                              ["transaction_id", "customer_id", "trans_id"])
    assert groups == {
        "DIM_CUSTOMER": ["customer_name", "customer_segment", "customer_id"],
        "DIM_ORDER": ["order_status"],
        "DIM_DIMENSION": ["region"],
        "DIM_TRANSACTION": ["transaction_id", "trans_id"],
    }


def _star_input(spark):
    rows = []
    for i in range(200):
        cust = None if i == 5 else i % 10
        name = f"name{i % 10}" if i != 25 else "renamed"  # a later row of customer 5
        rows.append((i, cust, name, ["A", "B"][i % 2], float(i * 3 % 97), dt.datetime(2024, 1, 1 + i % 28)))
    return spark.createDataFrame(
        rows, "sale_id long, customer_id long, customer_name string, store_type string, sales_amount double, "
              "sale_date timestamp")


def test_star_split_invariants(spark):
    df = _star_input(spark)
    p = profile_table(df, "sales")
    m = infer_model(p, candidate_keys(p), "sales")
    assert m.model_type == "star"
    tabs = split(df, m, "sales", order_by="sale_id", load_ts=TS)
    fact, dim = tabs["FACT_MAIN"], tabs["DIM_CUSTOMER"]
    assert fact.count() == 200                                                     # one fact row per input row
    assert dim.count() == 10                                                       # null NK dropped
    assert dim.select("DIM_CUSTOMER_SK").distinct().count() == 10                  # SK unique
    assert fact.where(F.col("customer_id_FK").isNull()).count() == 1               # NULL NK -> NULL FK
    first = dim.where("customer_id_NK = 5").first()["customer_name"]
    assert first == "name5"                                                        # first row by order wins
    assert orphan_keys(fact, dim, "customer_id_FK", "DIM_CUSTOMER_SK").count() == 0
    res = run_all(m, tabs)
    assert res.where("check_name = 'foreign_key_integrity'").count() == len(m.relationships)
    assert all(r["passed"] for r in res.where("check_name = 'foreign_key_integrity'").collect())
    # Same hashes regardless of partitioning of the input.
    again = split(df.repartition(5), m, "sales", order_by="sale_id", load_ts=TS)
    a = {tuple(r) for r in tabs["DIM_CUSTOMER"].collect()}
    b = {tuple(r) for r in again["DIM_CUSTOMER"].collect()}
    assert a == b


def test_pk_fk_null_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 9)], "k long, fk long")
    dim = spark.createDataFrame([(1,), (2,)], "pk long")
    assert duplicate_keys(df, ["k"]).first()["row_count"] == 2
    pk = check_pk(df, ["k"], "t").first()
    assert not pk["passed"] and pk["violation_count"] == 2
    assert check_pk(df, [], "t").first()["message"] == "No primary key columns specified"
    fk = check_fk(df, dim, "fk", "pk", "t -> d").first()
    assert fk["violation_count"] == 1 and fk["message"] == "Found 1 orphaned foreign keys"
    nv = null_violations(df, ["fk", "k", "missing"], "t").collect()
    assert [(r["column_name"], r["null_count"], r["null_percentage"]) for r in nv] == [("fk", 1, 25.0)]


def test_junk_key_and_sk_columns_options(spark):
    rows = [(i, ["P", "O", "F"][i % 3], ["1-URGENT", "2-HIGH"][i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_no long, order_status string, order_priority string, total_amount double")
    p = profile_table(df, "o")
    keys = candidate_keys(p)
    m1 = infer_model(p, keys, "o")
    assert m1.tables["DIM_ORDER"].natural_key == ["order_status"]
    m2 = infer_model(p, keys, "o", junk_key="all", sk_columns=["row_no"])
    assert m2.tables["DIM_ORDER"].natural_key == ["order_status", "order_priority"]
    t2 = split(df, m2, "o", order_by="row_no", load_ts=TS)
    assert t2["DIM_ORDER"].count() == 6
    assert orphan_keys(t2["FACT_MAIN"], t2["DIM_ORDER"], "order_status_FK", "DIM_ORDER_SK").count() == 0


def test_value_type_violations_and_orphan_sample(spark):
    from starweave.operators.quality import orphan_sample, value_type_violations

    df = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "amount string")
    r = value_type_violations(df, {"amount": "double"}, "t").first()
    assert (r["failed_count"], r["failed_percentage"]) == (1, 33.33)
    fact = spark.createDataFrame([(i,) for i in range(300)], "fk long")
    dim = spark.createDataFrame([(0,)], "pk long")
    s = [r["key"] for r in orphan_sample(fact, dim, "fk", "pk").collect()]
    assert s == list(range(1, 101))


def test_catalogue_models(spark):
    from starweave.operators.model import infer_models, models_frame
    from entry_plans import catalogue_profile

    p = catalogue_profile(spark, "/root/testdata/sf0.001")
    models = infer_models(p, candidate_keys(p))
    assert len(models) == 14
    tables = models_frame(models, "tables").collect()
    by_source = {}
    for r in tables:
        by_source.setdefault(r["source_table"], set()).add(r["table_name"])
    for src in ("orders", "lineitem", "events"):          # tables with a date column get DIM_DATE
        assert "DIM_DATE" in by_source[src]
    assert "DIM_DATE" not in by_source["region"]
    rels = models_frame(models, "relationships").where("source_table = 'lineitem'").count()
    assert rels == len(models["lineitem"].relationships)


def test_pairs_with_a_near_unique_column_match_brute_force(spark):
    rows = []
    for i in range(400):
        amount = None if i == 7 else (float(i) if i not in (11, 12, 13) else 11.0)  # repeats and a NULL
        rows.append((amount, i % 37, f"s{i % 41}", None if i % 50 == 0 else i % 23))
    df = spark.createDataFrame(rows, "amount double, a long, b string, c long")
    keys = candidate_keys(profile_table(df), min_uniqueness=0.5).collect()
    got = {(k["column_1"], k["column_2"]): k["distinct_count"] for k in keys if k["key_type"] == "composite"}
    names = ["amount", "a", "b", "c"]
    for i, x in enumerate(names):
        for y in names[i + 1:]:
            expected = len({(r[i], r[names.index(y)]) for r in rows})
            if expected >= 0.5 * len(rows):
                assert got[(x, y)] == expected, (x, y)
