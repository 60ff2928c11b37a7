"""What keeps the work on large tables small: narrow shuffle rows, one scan for many checks, compact files."""

import datetime as dt
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from starweave.operators import keys, quality
from starweave.operators.keys import candidate_keys
from starweave.operators.model import ModelColumn, ModelTable, infer_model
from starweave.operators.profile import profile_table, typed_frequencies
from starweave.operators.split import SplitContext, build_dimension, split, with_order
from starweave.plans import load

TS = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequencies_are_shuffled_by_column_number_and_plain_value(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), rng.choice([0.0, -0.0, float("nan"), None, 1.5]), rng.choice([None, "a", "b" * 70]),
             rng.choice([None, dt.date(2024, 1, 1)]), rng.choice([None, True, False])) for _ in range(300)]
    df = spark.createDataFrame(rows, "i int, d double, s string, day date, flag boolean")
    freq = typed_frequencies({"t": df, "u": df.select("s", F.col("i").cast("long").alias("i"))})
    plan = _plan(freq)
    assert "hashpartitioning(number" in plan and "hashpartitioning(table_name" not in plan
    got = {(r["table_name"], r["column_name"], None if r["value"] is None else next(v for v in r["value"] if v is not None)): r["cnt"]
           for r in freq.collect()}
    want = Counter()
    for r in rows:
        for name, v in zip(("i", "d", "s", "day", "flag"), r):
            v = None if v != v else v
            v = str(v).lower() if isinstance(v, bool) else v
            if name == "s" and v is not None and len(v) > 64:
                v = next(k[2] for k in got if k[2] is not None and str(k[2]).startswith("#"))
            want[("t", name, v)] += 1
            if name in ("i", "s"):
                want[("u", name, v)] += 1
    assert got == want


def test_pairs_of_one_leading_column_shuffle_one_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *range(9)]), rng.choice("xyz"), float(rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a long, b int, c string, d double").repartition(5)
    pairs = [(0, "a", "b"), (1, "a", "c"), (2, "a", "d"), (3, "d", "b")]
    counted = keys.lead_counts(df, pairs, 0, keys.SLICES)
    plan = _plan(counted)
    assert "Generate explode" not in plan and plan.count("hashpartitioning(x") == 1
    at = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["pair"]: (r["distinct"], r["rows"]) for r in counted.collect()} == {
        i: (len({(r[at[a]], r[at[b]]) for r in rows}), len(rows)) for i, a, b in pairs}


def test_groups_are_counted_across_batches_and_chunks(monkeypatch):
    monkeypatch.setattr(keys, "CHUNK_ROWS", 30)
    rng = random.Random(5)
    rows = sorted((rng.randrange(-20, 20), lead, rng.randrange(4), rng.randrange(2)) for lead in (0, 1) for _ in range(400))
    names = ["lead", "x", "y0", "y1"]
    table = [pa.RecordBatch.from_pydict({"lead": [r[1] for r in part], "x": [r[0] for r in part], "y0": [r[2] for r in part],
                                         "y1": [r[3] for r in part]}) for part in (rows[i:i + 7] for i in range(0, len(rows), 7))]
    assert table[0].schema.names == names
    out = next(keys._group_counter([[5, 6], [7]])(iter(table))).to_pylist()
    assert {r["pair"]: (r["distinct"], r["rows"]) for r in out} == {
        p: (len({(r[0], r[k]) for r in rows if r[1] == lead}), 400) for p, lead, k in ((5, 0, 2), (6, 0, 3), (7, 1, 2))}


def test_hot_leading_values_give_the_same_keys(spark, monkeypatch):
    rows = [(i % 500 if i % 3 else None, i // 7, f"c{i % 11}", float(i % 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, c string, d double")
    wanted = sorted(map(str, candidate_keys(profile_table(df), min_uniqueness=0.5).collect()))
    assert wanted
    monkeypatch.setattr(keys, "GROUP_ROWS", 300)
    assert sorted(map(str, candidate_keys(profile_table(df), min_uniqueness=0.5).collect())) == wanted


def _odd_rows(spark):
    rng = random.Random(6)
    day = lambda: dt.datetime(1969, 12, 1) + dt.timedelta(days=rng.randrange(60))
    rows = [(rng.choice([None, -7, 0, 90]), rng.choice([None, -2 ** 63, 2 ** 63 - 1, 5]), rng.choice([None, float("nan"), -0.0, 0.0, -0.25, 1.5]),
             rng.choice([None, float("inf"), 0.1, 1e300]), rng.choice([None, 1 / 3, 2.0]), rng.choice([None, day()]), rng.choice([None, day().date()]),
             day() + dt.timedelta(microseconds=rng.randrange(3)), rng.choice([None, dt.datetime(1969, 12, 31, 23, 59, 58, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)]),
             rng.choice([None, "", "a", "b" * 70, "b" * 71]), rng.choice([None, True, False]), rng.randrange(60), f"n{rng.randrange(80)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "whole int, wide long, part double, far double, third double, day timestamp_ntz, date date, moment timestamp_ntz, "
                                     "zoned timestamp, text string, flag boolean, lead long, name string")
    return df.repartition(5), rows


def _codes(df):
    p = profile_table(df)
    distinct = {r["column_name"]: r["distinct_count"] for r in p.column_profile().collect()}
    _, spans = keys._pair_bounds(p, "input", distinct)
    return keys.value_codes(p, "input", df.columns, distinct, spans)


def _same_value(v):
    return None if v != v else v + 0.0 if isinstance(v, float) else v


def test_codes_are_short_and_tell_values_apart(spark):
    df, rows = _odd_rows(spark)
    codes = _codes(df)
    assert set(codes) == set(df.columns)
    assert {c: codes[c].bits for c in ("whole", "part", "day", "date", "zoned", "lead")} == {
        "whole": 7, "part": 8, "day": 6, "date": 6, "zoned": 31, "lead": 6}
    assert all(code.bits <= 2 * 11 + 4 for c, code in codes.items() if c != "zoned")
    coded = df.select(*df.columns, *[keys._value_code(df, c, code).alias(f"_{c}") for c, code in codes.items()]).collect()
    for c, code in codes.items():
        pairs = {(_same_value(r[c]), r[f"_{c}"]) for r in coded}
        assert len(pairs) == len({v for v, _ in pairs}) == len({n for _, n in pairs}), c
        assert all(0 <= n < 2 ** code.bits and (n == 0) == (v is None) for v, n in pairs), c


def test_pairs_are_shuffled_as_codes_in_few_words(spark, monkeypatch):
    df, rows = _odd_rows(spark)
    at = {c: i for i, c in enumerate(df.columns)}
    others = [c for c in df.columns if c not in ("lead", "name")]
    pairs = [(i, lead, c) for i, (lead, c) in enumerate((lead, c) for lead in ("lead", "name") for c in [*others, "lead"] if c != lead)]
    wanted = {i: (len({(r[at[a]], _same_value(r[at[b]])) for r in rows}), len(rows)) for i, a, b in pairs}
    codes = _codes(df)
    counted = keys.lead_counts(df, pairs, 0, keys.SLICES, codes)
    plan = _plan(counted)
    assert plan.count("Exchange hashpartitioning(") == 2 and " y1#" in plan and " y2#" not in plan  # a row has three words for 12 columns
    some = {c: code for c, code in codes.items() if c in ("whole", "text", "lead")}
    name = {"name": codes["name"]}
    for given in (codes, some, name, {}):
        assert {r["pair"]: (r["distinct"], r["rows"]) for r in keys.lead_counts(df, pairs, 0, keys.SLICES, given).collect()} == wanted
    sliced = Counter()
    for lo, hi in keys.ROUNDS:
        for r in keys.lead_counts(df, pairs, lo, hi, codes).collect():
            sliced[r["pair"], "distinct"] += r["distinct"]
            sliced[r["pair"], "rows"] += r["rows"]
    assert {i: (sliced[i, "distinct"], sliced[i, "rows"]) for i in wanted} == wanted
    monkeypatch.setattr(keys, "HASHED_VALUES", 0)
    assert "text" not in _codes(df) and "whole" in _codes(df)


def test_hash_codes_with_collisions_are_not_used(spark):
    df = spark.createDataFrame([(f"t{i}", i % 7) for i in range(300)], "text string, whole long")
    p = profile_table(df)
    distinct = {"text": 3, "whole": 7}  # a wrong number of values, so that the hash gets too few bits
    _, spans = keys._pair_bounds(p, "input", distinct)
    assert set(keys.value_codes(p, "input", ["text", "whole"], distinct, spans)) == {"whole"}


def test_sales_wide_shuffles_line_items_without_customer_columns(spark, tmpdir_path):
    from entry_wide import sales_wide

    day = dt.datetime(2024, 1, 1)
    line = [(o, p, s, n, 1.0 * n, 2.5, 0.1, 0.0, "A", "O", day) for n, (o, p, s) in enumerate(
        [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (None, 1, 1), (3, None, 1), (9, 1, 1), (4, 9, 1), (3, 2, None)])]
    order = [(1, 1, "F", 1.0, day, "1"), (1, 1, "O", 1.0, day, "2"), (2, 2, "F", 1.0, day, "1"), (3, None, "F", 1.0, day, "1"), (4, 3, "P", 1.0, day, "1"),
             (None, 1, "F", 1.0, day, "1"), (3, 4, "F", 1.0, day, "3")]
    customer = [(1, "c1", 1, 0.0, "M"), (2, "c2", 2, 0.0, "M"), (2, "c2", 1, 0.0, None), (3, "c3", 9, 0.0, "M"), (4, "c4", 1, 0.0, "M"), (None, "x", 1, 0.0, "M")]
    part = [(1, "p", "b1", "t1", 1, 1.0), (2, "p", "b2", None, 1, 1.0), (2, "p", "b3", "t3", 1, 1.0), (None, "p", "b", "t", 1, 1.0)]
    nation = [(1, "n1", 1), (2, "n2", 1)]
    for name, rows, schema in (
            ("lineitem", line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                               "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
            ("orders", order, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
            ("customer", customer, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
            ("nation", nation, "n_nationkey int, n_name string, n_regionkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmpdir_path}/{name}.parquet")
    wanted = Counter(
        (o[0] * 10 + x[3], c[0], c[1], c[4], n[1], p[0], p[2], p[3], x[4], x[5], x[6], o[2], o[5], x[10], o[4])
        for x in line for o in order if x[0] == o[0] is not None for c in customer if o[1] == c[0] is not None
        for n in nation if c[2] == n[0] for p in part if x[1] == p[0] is not None)
    assert wanted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = sales_wide(spark, tmpdir_path)
        plan = _plan(df).splitlines()
        assert Counter(map(tuple, df.collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda text: len(text) - len(text.lstrip(" :+-*(0123456789)"))
    shuffled = []
    for i, text in enumerate(plan):
        if "Exchange hashpartitioning(" in text:
            below = next((k for k in range(i + 1, len(plan)) if depth(plan[k]) <= depth(text)), len(plan))
            shuffled.append(" ".join(plan[i:below]))
    with_lines = [text for text in shuffled if "l_orderkey" in text]
    assert len(with_lines) == 2 and not any("c_name" in text for text in with_lines)


def _split(spark):
    df = spark.createDataFrame([(i, i % 40, f"n{i % 40}", float(i)) for i in range(400)],
                               "sale_id long, customer_id long, customer_name string, sales_amount double")
    p = profile_table(df, "s")
    model = infer_model(p, candidate_keys(p), "s")
    return model, split(df, model, "s", order_by="sale_id", load_ts=TS)


def test_checks_do_not_compute_split_tables_anew(spark):
    model, tables = _split(spark)
    checks = quality.run_all(model, tables, include_types=True)
    plan = _plan(checks)
    assert "sha2" not in plan and "checked-fact_main" in plan
    assert checks.where("not passed").count() == 0 and checks.where("check_name = 'data_types'").count() == len(tables)


def test_order_is_written_once_and_first_rows_are_shuffled_once(spark):
    model, tables = _split(spark)
    dim = tables["DIM_CUSTOMER"]
    plan = _plan(dim)
    assert "conv(" not in plan  # the order value is read
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = dim.select("*")
        assert _plan(joined).count("Exchange hashpartitioning") == 3  # rows; least by key; least by key and order
        assert {r["customer_id_NK"]: r["customer_name"] for r in joined.collect()} == {k: f"n{k}" for k in range(40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_order_of_other_columns_replaces_the_written_one(spark):
    df = spark.createDataFrame([(1, "b", 9, "x"), (1, "a", 3, "y"), (2, None, 5, "z"), (2, "a", 1, "w"), (2, None, 5, "z")],
                               "k long, t string, n long, v string")
    firsts = {}
    table = ModelTable("D", "DIM", [ModelColumn("v", "STRING", True, "attribute", "v")], ["D_SK"], natural_key=["k"])
    for name, frame in (("n", with_order(with_order(df, "t"), "n")), ("t", with_order(with_order(df, "n"), "t"))):
        out = build_dimension(frame, table, SplitContext("s", TS)).collect()
        firsts[name] = sorted((r["k_NK"], r["v"]) for r in out)
    assert firsts == {"n": [(1, "y"), (2, "w")], "t": [(1, "y"), (2, "z")]}
    assert [c for c in with_order(with_order(df, "t"), "n").columns if c.startswith("__order")] == ["__order0"]


def test_load_tests_only_columns_that_can_fail(spark):
    target = T.StructType([T.StructField("a", T.DecimalType(38, 0)), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType()),
                           T.StructField("d", T.DecimalType(18, 0)), T.StructField("e", T.DoubleType()), T.StructField("f", T.LongType())])
    df = spark.createDataFrame([(2 ** 63 - 1, "x", 2 ** 31, 10 ** 18, float("nan"), 5), (-2 ** 63, None, None, None, None, None), (1, "", 7, 8, 9.5, 6)],
                               "a long, b string, c long, d long, e double, f int")
    source = {c: F.col(c) for c in df.columns}
    marked, values = load._checked(df, source, target, F.lit(False))
    assert [r["__error"] for r in marked.collect()] == ["cannot convert: c, d", None, None]
    plan = _plan(marked)
    assert "cannot convert" in plan and not any(f"THEN {c} END" in plan for c in "abef")
    assert marked.where("__error IS NULL").select(*values).count() == 2
    fits = ["a", "b", "e", "f"]
    part, _ = load._checked(df.select(*fits), {c: source[c] for c in fits}, target, F.lit(False))
    assert "cannot convert" not in _plan(part) and [r["__error"] for r in part.collect()] == [None] * 3


def test_row_hashes_are_shuffled_as_bytes_and_written_as_zstd(spark, tmpdir_path):
    import glob

    import pyarrow.parquet as pq

    from starweave.plans import sinks

    _, tables = _split(spark)
    assert "unhex(__row_hash" in _plan(tables["DIM_CUSTOMER"])
    sinks.write_tables(spark, {"DIM_CUSTOMER": tables["DIM_CUSTOMER"]}, tmpdir_path).collect()
    files = glob.glob(sinks.table_path(tmpdir_path, "DIM_CUSTOMER") + "/*.parquet")
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)
    hashes = {r["ROW_HASH"] for r in spark.read.parquet(sinks.table_path(tmpdir_path, "DIM_CUSTOMER")).collect()}
    assert hashes <= {r["ROW_HASH"] for r in tables["FACT_MAIN"].collect()} and len(hashes) == 40
