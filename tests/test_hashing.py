import hashlib
import math
import random

import numpy as np

from starweave.functions.hashing import canonical_text, hash_frame_columns
from pyspark.sql import types as T


def test_float_text_matches_python_str(spark):
    rnd = random.Random(3)
    vals = [1e7, 12345678.9, 1e16, 1.5e16, 1e-4, 1.5e-5, 0.001, 123.456, 1e22, 1e-7, -2.5e-6, 1e300,
            9999999.999, 0.00012345, 123456789012345.6, 2.5e-4, 1.0, -0.0, 100.0, -1e7, 0.1, 1e15, 9.999e15]
    # realistic values: up to 15 significant digits (exact by construction), over a wide exponent range
    vals += [float(f"{rnd.uniform(-1, 1) * 10:.{rnd.randint(1, 15)}e}".split("e")[0] + f"e{rnd.randint(-12, 24)}")
             for _ in range(300)]
    vals += [-7.391544078297146e+17]  # 16 digits where some JVMs' Double.toString writes 17
    df = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),), (float("inf"),), (None,)], "x double")
    got = [r[0] for r in df.select(canonical_text("x", T.DoubleType())).collect()]
    want = [str(v) for v in vals] + [None, "inf", None]
    assert got == want


def test_float32_text_matches_numpy_str(spark):
    vals = [np.float32(v) for v in (1e7, 0.1, 2.5e-5, 123.25, 3.4e38, 1e-4, 999999.0, 1234567.0, 0.00015, 16777216.0)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x float")
    got = [r[0] for r in df.select(canonical_text("x", T.FloatType())).collect()]
    assert got == [str(v) for v in vals]


def test_row_hash_matches_python_rule(spark):
    rows = [(1, "a", 2.5e-5, True, None), (2, None, 1e16, False, 3.0)]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean, m double")
    got = [r[0] for r in df.select(hash_frame_columns(df, df.columns)).collect()]
    want = [hashlib.sha256("|".join("" if v is None else str(v) for v in r).encode()).hexdigest() for r in rows]
    assert got == want


def test_timestamps_have_six_digits_and_are_utc(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 03:04:05.5+02:00' AS t, timestamp_ntz'2024-01-02 03:04:05.25' AS n, "
                   "timestamp'2024-01-02 00:00:00Z' AS w")
    row = df.select(*[canonical_text(c, df.schema[c].dataType) for c in df.columns]).first()
    assert tuple(row) == ("2024-01-02 01:04:05.500000", "2024-01-02 03:04:05.250000", "2024-01-02 00:00:00")


def test_dotted_names_and_repeatable_first_row(spark):
    import datetime as dt

    from starweave.operators.keys import candidate_keys
    from starweave.operators.model import infer_model
    from starweave.operators.profile import profile_table
    from starweave.operators.split import split

    rows = [(i, i % 3, f"n{i % 9}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "`sale.id` long, customer_id long, customer_name string, `unit.price` double")
    p = profile_table(df, "s")
    m = infer_model(p, candidate_keys(p), "s")
    firsts = []
    for parts in (1, 5):
        tables = split(df.repartition(parts), m, "s", order_by="customer_id", load_ts=dt.datetime(2024, 1, 1))
        firsts.append({n: sorted(map(str, t.collect())) for n, t in tables.items()})
    assert firsts[0] == firsts[1] and len(firsts[0]["DIM_CUSTOMER"]) == 3
