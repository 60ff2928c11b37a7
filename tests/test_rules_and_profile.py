import datetime as dt
import hashlib

import numpy as np
import pandas as pd

from starweave.operators.profile import profile_table, histogram
from starweave.operators.quantiles import exact_quantiles


def _roles(p):
    return {r["column_name"]: (r["logical_type"], r["entity_role"]) for r in p.entity_roles().collect()}


def test_name_traps(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3, True), (2, 3.0, "b", 4, False)],
                               "update_count long, lifetime_value double, guid string, ID long, valid boolean")
    r = _roles(profile_table(df))
    assert r["update_count"] == ("DATE", "dates")
    assert r["lifetime_value"] == ("DATE", "dates")
    assert r["guid"] == ("ID", "ids")
    assert r["ID"] == ("ID", "ids")
    assert r["valid"] == ("BOOLEAN", None)


def test_roles_by_ratio_and_measure_terms(spark):
    rows = [(i, i % 3, float(i), f"s{i % 2}", f"u{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "n long, code long, price double, kind string, uniq string")
    r = _roles(profile_table(df))
    assert r["n"][1] == "facts"          # high cardinality number
    assert r["code"][1] == "dimensions"  # ratio 0.03 < 0.1
    assert r["price"][1] == "facts"      # measure term
    assert r["kind"][1] == "dimensions"  # ratio 0.02 < 0.5
    assert r["uniq"][1] is None          # wide text takes no role


def test_empty_frame_profile(spark):
    df = spark.createDataFrame([], "a long, b string")
    p = profile_table(df)
    rows = {r["column_name"]: r for r in p.column_profile().collect()}
    assert rows["a"]["total_rows"] == 0 and rows["a"]["distinct_count"] == 0
    assert rows["b"]["null_percentage"] == 0.0
    assert {r["entity_role"] for r in p.entity_roles().collect()} <= {"dimensions", None}


def test_nulls_distinct_and_anomalies(spark):
    rows = [(None if i % 4 else i, 7, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "mostly_null long, const long, c string")
    p = profile_table(df)
    cp = {r["column_name"]: r for r in p.column_profile().collect()}
    assert cp["mostly_null"]["null_count"] == 30
    assert cp["mostly_null"]["null_percentage"] == 75.0
    assert cp["mostly_null"]["distinct_count"] == 10
    issues = {(r["column_name"], r["issue"]) for r in p.anomalies().collect()}
    assert ("mostly_null", "High null percentage") in issues
    assert ("const", "Constant value (no variation)") in issues


def test_iqr_outliers(spark):
    vals = [(float(i),) for i in range(1, 101)] + [(10000.0,)]
    p = profile_table(spark.createDataFrame(vals, "amount double"))
    r = p.numeric_profile().first()
    s = pd.Series([v[0] for v in vals])
    assert r["q1"] == s.quantile(0.25) and r["q3"] == s.quantile(0.75)
    assert r["median"] == s.median()
    assert r["outlier_count"] == 1


def test_exact_quantiles_match_pandas_with_hot_value(spark):
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.normal(size=3000), np.full(1500, 0.5)])  # one value holds a third of the rows
    rng.shuffle(data)
    df = spark.createDataFrame([("g", float(x)) for x in data], "g string, v double").repartition(7)
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, "g", "v", [0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    s = pd.Series(data)
    for p, v in got.items():
        assert abs(v - s.quantile(p)) < 1e-12


def test_broken_dates(spark):
    df = spark.createDataFrame([("2024-01-02",), ("garbage",), (None,)], "event_date string")
    r = profile_table(df).date_profile().first()
    assert (r["valid_date_count"], r["invalid_date_count"]) == (1, 2)
    assert r["min_date"].startswith("2024-01-02")


def test_string_stats_and_top_values_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("ccc",), (None,)], "name string")
    p = profile_table(df)
    s = p.string_profile().first()
    assert s["avg_length"] == 1.4 and s["max_length"] == 3
    top = [(r["value"], r["count"]) for r in p.top_values().orderBy("rank").collect()]
    ties = sorted("ab", key=lambda v: hashlib.sha256(v.encode()).hexdigest())  # one rule for values of any length
    assert top == [(ties[0], 2), (ties[1], 2), ("ccc", 1)]


def test_long_values_counted_by_digest_and_resolved(spark):
    long_a, long_b = "x" * 100, "y" * 100
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,)], "body string")
    p = profile_table(df)
    assert p.column_profile().first()["distinct_count"] == 2
    top = p.top_values().orderBy("rank").first()
    assert top["value"] == long_a and top["count"] == 2 and top["value_key"].startswith("#")


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    h = {r["bin"]: r["count"] for r in histogram(df, "x", bins=10).collect()}
    assert sum(h.values()) == 101 and max(h) == 10 and h[10] == 11  # the maximum joins the last bin


def test_grain(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "user_id long, created_date date")
    assert profile_table(df).grain().first()["grain"] == "event"


def test_approx_numeric_profile_close_to_exact(spark):
    df = spark.createDataFrame([(float(i % 1000),) for i in range(20000)], "amount double")
    p = profile_table(df)
    exact = p.numeric_profile().first()
    approx = p.numeric_profile(approx=True).first()
    assert approx["total_rows"] == exact["total_rows"] and approx["mean"] == exact["mean"]
    assert abs(approx["median"] - exact["median"]) <= 1.0


def test_lenient_date_parsing(spark):
    df = spark.createDataFrame([("2024-01-15",), ("01/16/2024",), ("2024/01/17",), ("20240118",), ("Jan 19, 2024",),
                                ("garbage",), ("13/45/2024",)], "order_date string")
    r = profile_table(df).date_profile().first()
    assert (r["valid_date_count"], r["invalid_date_count"]) == (5, 2)
    assert r["min_date"].startswith("2024-01-15") and r["max_date"].startswith("2024-01-19")


def test_quantiles_with_narrowed_brackets(spark, monkeypatch):
    from starweave.operators import quantiles

    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.lognormal(sigma=3, size=900)] + [("b", float(k % 7)) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.999]).collect()}
    for g in "ab":
        s = pd.Series([v for k, v in rows if k == g])
        for p in (0.0, 0.25, 0.5, 0.999):
            assert np.isclose(got[(g, p)], s.quantile(p), rtol=1e-12)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "amount double")
    p = profile_table(df)
    c, n = p.column_profile().first(), p.numeric_profile().first()
    assert (c["null_count"], c["distinct_count"]) == (1, 2)
    assert (n["max"], n["mean"], n["median"]) == (2.0, 1.5, 1.5)


def test_many_columns_candidate_keys(spark):
    """60 columns: the pairs are counted in batches; only real keys are found."""
    from starweave.operators.keys import candidate_keys

    rows = [tuple((i // 2 if c == 0 else i % 2 if c == 1 else (i * (c + 3)) % (20 + c)) for c in range(60)) for i in range(240)]
    df = spark.createDataFrame(rows, ", ".join(f"c{c} int" for c in range(60)))
    got = {(r["column_1"], r["column_2"]): r["distinct_count"] for r in candidate_keys(profile_table(df)).collect()}
    want = {}
    for a in range(60):
        for b in range(a + 1, 60):
            d = len({(r[a], r[b]) for r in rows})
            if d >= 0.95 * 240:
                want[(f"c{a}", f"c{b}")] = d
    assert got == want and ("c0", "c1") in got
