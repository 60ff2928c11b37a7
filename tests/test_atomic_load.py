"""Loads that are all or nothing and can be repeated; appends that reject instead of storing NULL."""

import os
from decimal import Decimal

import pytest

from starweave.operators.model import Model, ModelColumn, ModelTable
from starweave.plans import audit, load


@pytest.fixture()
def place(spark, tmpdir_path):
    """(database, model of one table, function that writes the table's next file set)."""
    db = f"sw_atomic_{os.path.basename(tmpdir_path).replace('-', '_').lower()}"
    table = ModelTable("T", "FACT", [ModelColumn("id", "NUMBER(38,0)", False, "pk"), ModelColumn("v", "TEXT", True, "attribute")], ["id"])
    model = Model(spark, "t", "star", "row", {"T": table}, [], {}, [], ["id"])

    def files(name, rows):
        path = os.path.join(tmpdir_path, name)
        spark.createDataFrame(rows, "id long, v string").write.parquet(path)
        return path

    return db, model, files, os.path.join(tmpdir_path, "wh")


def rows(spark, db):
    return sorted((int(r["id"]), r["v"]) for r in spark.table(f"{db}.T").collect())


def test_a_load_is_repeatable(spark, place):
    db, model, files, wh = place
    first, second = files("a", [(1, "x"), (2, "y")]), files("b", [(3, "z")])
    for _ in range(2):
        res = load.load_all(spark, model, {"T": first}, "s", db, location=wh, load_id="monday")
        assert res["status"] == "SUCCESS" and res["tables"][0]["rows_loaded"] == 2 and rows(spark, db) == [(1, "x"), (2, "y")]
    load.load_all(spark, model, {"T": second}, "s", db, location=wh, load_id="tuesday")
    load.load_all(spark, model, {"T": first}, "s", db, location=wh, load_id="monday")  # late again: changes nothing
    assert rows(spark, db) == [(3, "z")] and audit.commits(spark, db, "T").count() == 2
    assert [r["STATUS"] for r in audit.recent_runs(spark, db).collect()] == ["SUCCESS"] * 4


def test_failures_leave_the_table_as_it_was(spark, place, monkeypatch):
    db, model, files, wh = place
    first, second = files("a", [(1, "x")]), files("b", [(2, "y"), (3, "z")])
    load.load_all(spark, model, {"T": first}, "s", db, location=wh, load_id="one")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # written, but not committed
        m.setattr(audit, "log_commit", broken)
        res = load.load_all(spark, model, {"T": second}, "s", db, location=wh, load_id="two")
        assert res["status"] == "FAILED" and rows(spark, db) == [(1, "x")]
    with monkeypatch.context() as m:  # committed, but the table still points at the old rows
        m.setattr(load, "_point", broken)
        assert load.load_all(spark, model, {"T": second}, "s", db, location=wh, load_id="two")["status"] == "FAILED"
        assert rows(spark, db) == [(1, "x")]
    assert load.load_all(spark, model, {"T": second}, "s", db, location=wh, load_id="two")["status"] == "SUCCESS"
    assert rows(spark, db) == [(2, "y"), (3, "z")] and audit.commits(spark, db, "T").count() == 2
    missing = load.load_all(spark, model, {"T": second + "-missing"}, "s", db, location=wh)
    assert missing["status"] == "FAILED" and rows(spark, db) == [(2, "y"), (3, "z")]


def test_append_rejects_what_does_not_fit(spark, tmpdir_path):
    db = "sw_test_append"
    load.create_namespace(spark, db, os.path.join(tmpdir_path, "wh"))
    spark.sql(f"CREATE TABLE {db}.t (n INT, d DECIMAL(38,0), note STRING, extra DOUBLE) USING parquet")
    nan = float("nan")
    df = spark.createDataFrame([("x", 1.0, "p"), ("2", 2.5, "q"), ("3", 1e20, "r"), (None, nan, "s"), ("7D", 4.0, None)],
                               "n string, d double, note string")
    res = load.append_by_name(spark, df, db, "t")
    assert (res.rows_parsed, res.rows_loaded, res.errors_seen) == (5, 2, 3)
    got = sorted((tuple(r) for r in spark.table(f"{db}.t").collect()), key=repr)
    assert got == sorted([(3, Decimal(10) ** 20, "r", None), (None, None, "s", None)], key=repr)
    assert sorted(r["error_message"] for r in res.rejects.collect()) == ["cannot convert: d", "cannot convert: n", "cannot convert: n"]
