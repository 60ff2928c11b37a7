import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def test_every_query_has_an_oracle():
    """Queries of the optional subpackage are checked in its own tests."""
    llm = set(E.llm_queries.QUERIES) | {"pipeline"} if E.llm_queries else set()
    assert set(E.queries()) - llm == set(E.oracle_sql()) - llm


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert rows and all(r["passed"] for r in rows)
    assert {r["table_name"] for r in rows} >= {"FACT_MAIN", "DIM_CUSTOMER", "DIM_DATE"}


def _norm(v):
    import math
    import numbers

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, numbers.Number):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", [
    "column_profile_orders_wide", "numeric_profile_lineitem", "candidate_keys_events", "top_values_documents",
    "dim_customer", "fact_main", "dq_pk_lineitem", "dq_fk_orphans_labels", "anomalies_all",
])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in E.CATALOGUE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    cols = sorted(got.columns)
    key = lambda t: repr(t)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in got.to_dict("records")), key=key)
    b = sorted((tuple(_norm(r[c]) for c in cols) for r in exp.to_dict("records")), key=key)
    assert len(a) == len(b)
    assert [str(x) for x in a] == [str(x) for x in b]
