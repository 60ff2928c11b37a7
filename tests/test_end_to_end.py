"""The whole flow from a CSV file, as a user runs it: read (sniffed) -> profile -> model -> split -> check ->
write -> load, compared with the same flow on the Parquet-derived frame."""

import os

from starweave.operators.keys import candidate_keys
from starweave.operators.model import infer_model
from starweave.operators.profile import profile_table
from starweave.operators.quality import run_all
from starweave.operators.split import split
from starweave.plans import audit, load, sinks
from entry_wide import orders_wide
from starweave.sources import read_any

SF = "/root/testdata/sf0.001"


def _model(df, name):
    p = profile_table(df, name)
    return p, infer_model(p, candidate_keys(p), name)


def test_csv_file_to_loaded_star_schema(spark, tmpdir_path):
    wide = orders_wide(spark, SF)
    csv_dir = os.path.join(tmpdir_path, "orders_wide_csv")
    wide.coalesce(1).write.option("header", True).csv(csv_dir)
    df = read_any(spark, csv_dir, "csv")
    assert df.count() == wide.count()

    _, m_parquet = _model(wide, "orders_wide")
    p, m = _model(df, "orders_wide")
    assert m.model_type == m_parquet.model_type == "star"
    assert {t: [c.name for c in tb.columns] for t, tb in m.tables.items()} == \
        {t: [c.name for c in tb.columns] for t, tb in m_parquet.tables.items()}

    tables = split(df, m, "orders_wide.csv", order_by="transaction_id")
    checks = run_all(m, tables).collect()
    assert checks and all(r["passed"] for r in checks)

    summary = sinks.write_tables(spark, tables, os.path.join(tmpdir_path, "model")).collect()
    paths = {r["table_name"]: r["path"] for r in summary}
    res = load.load_all(spark, m, paths, "orders_wide.csv", "sw_e2e",
                        expected_rows={r["table_name"]: r["row_count"] for r in summary},
                        location=os.path.join(tmpdir_path, "wh"))
    assert res["status"] == "SUCCESS"
    counts = {r["table_name"]: r["actual"] for r in
              load.validate_row_counts(spark, "sw_e2e", {r["table_name"]: r["row_count"] for r in summary}).collect()}
    assert counts["FACT_MAIN"] == wide.count()
    assert counts["DIM_CUSTOMER"] == wide.select("customer_id").distinct().count()
    assert audit.summary(spark, "sw_e2e").first()["STATUS"] == "SUCCESS"
