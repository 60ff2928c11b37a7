import json
import os

from starweave.operators.keys import candidate_keys
from starweave.operators.model import infer_model
from starweave.operators.profile import profile_table
from starweave.operators.split import split
from starweave.plans import audit, load, sinks
from starweave.sources import (
    file_metadata, flatten_nested, read_any, read_csv, sniff_delimiter, sniff_encoding, validate_source,
)


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_short_rows_padded_long_rows_skipped(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.csv"),
               'id,name,amount\n1,"x, y",2.5\n2,short\n3,long,1.0,extra\n4,ok,4.0\n5,two,1.0,e1,e2\n')
    res = read_csv(spark, p, with_rejects=True)
    rows = sorted(tuple(r) for r in res.rows.collect())
    assert rows == [(1, "x, y", 2.5), (2, "short", None), (4, "ok", 4.0)]
    assert dict(res.rows.dtypes) == {"id": "int", "name": "string", "amount": "double"}
    assert res.rejects.count() == 2


def test_delimiter_and_encoding_sniffing(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "semi.csv"), "a;b\n1;2\n")
    assert sniff_delimiter(spark, p) == ";"
    q = _write(os.path.join(tmpdir_path, "latin.csv"), "name,city\nJosé,Málaga\n", encoding="latin-1")
    assert sniff_encoding(spark, q) == "iso-8859-1"
    rows = read_csv(spark, q).collect()
    assert rows[0]["name"] == "José"


def test_json_formats_validation_and_metadata(spark, tmpdir_path):
    doc = _write(os.path.join(tmpdir_path, "d.json"), json.dumps([{"a": 1, "b": {"c": 2}}, {"a": 2, "b": {"c": 3}}]))
    lines = _write(os.path.join(tmpdir_path, "d.jsonl"), '{"a": 1}\n{"a": 2}\n')
    assert read_any(spark, doc).count() == 2
    assert read_any(spark, lines).count() == 2
    assert validate_source(spark, doc) == (True, None)
    assert validate_source(spark, os.path.join(tmpdir_path, "nope.csv"))[0] is False
    assert validate_source(spark, _write(os.path.join(tmpdir_path, "x.xml"), "<a/>"))[1].startswith("Unsupported")
    meta = file_metadata(spark, lines).first()
    assert meta["size_bytes"] == os.path.getsize(lines)


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, (2, "x"), [(1.0,), (2.0,)]), (2, (3, "y"), [])],
                               "id long, info struct<n:long, s:string>, items array<struct<v:double>>")
    out = flatten_nested(df, ["id"])
    assert out["parent"].columns == ["PARENT_SK", "id", "info_n", "info_s"]
    assert sorted(tuple(r)[1:] for r in out["items"].collect()) == [(1, 0, 1.0), (1, 1, 2.0)]
    sks = {r["PARENT_SK"] for r in out["items"].collect()}
    parent_sk = out["parent"].where("id = 1").first()["PARENT_SK"]
    assert sks == {parent_sk}


def test_headerless_csv_and_per_file_sniffing(spark, tmpdir_path):
    import os

    from starweave.sources.sniff import sniff_delimiters

    p = _write(os.path.join(tmpdir_path, "nohdr.csv"), "1,a\n2,b\n")
    df = read_csv(spark, p, header=False)
    assert df.columns == ["_c0", "_c1"] and df.count() == 2
    d = os.path.join(tmpdir_path, "many")
    os.makedirs(d)
    _write(os.path.join(d, "x.csv"), "a|b\n1|2\n")
    _write(os.path.join(d, "y.csv"), "a\tb\n1\t2\n")
    found = {os.path.basename(r["file_path"]): r["delimiter"] for r in sniff_delimiters(spark, d).collect()}
    assert found == {"x.csv": "|", "y.csv": "\t"}


def test_write_load_audit_runs(spark, tmpdir_path):
    rows = [(i, i % 4, f"c{i % 4}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "order_id long, customer_id long, customer_name string, total_amount double")
    p = profile_table(df, "orders")
    m = infer_model(p, candidate_keys(p), "orders")
    tabs = split(df, m, "orders.csv", order_by="order_id")
    from starweave.operators.model import recommend_clustering

    layout = sinks.clustering_layout(recommend_clustering(m, p))
    layout["DIM_CUSTOMER"] = ["customer_id_NK"]
    summary = sinks.write_tables(spark, tabs, os.path.join(tmpdir_path, "out"), sort_within=layout).collect()
    assert all(r["error"] is None for r in summary)
    totals = sinks.split_totals(spark.createDataFrame(summary, sinks.SUMMARY_SCHEMA)).first()
    assert totals["tables_written"] == len(summary) and totals["total_rows"] == sum(r["row_count"] for r in summary)
    paths = {r["table_name"]: r["path"] for r in summary}
    expected = {r["table_name"]: r["row_count"] for r in summary}
    from starweave.operators.quality import load_split_tables, run_all

    back, failed = load_split_tables(spark, m, {**paths, "DIM_GONE": paths["FACT_MAIN"] + "_missing"})
    assert failed.count() == 1 and failed.first()["check_name"] == "file_load"
    assert back["FACT_MAIN"].schema["total_amount"].dataType.simpleString() == "double"
    assert all(r["passed"] for r in run_all(m, back).collect())
    db = "sw_test_audit"
    loc = os.path.join(tmpdir_path, "wh")
    r1 = load.load_all(spark, m, paths, "orders.csv", db, expected_rows=expected, location=loc)
    assert r1["status"] == "SUCCESS" and r1["run_id"] == 1
    assert all(r["passed"] for r in load.validate_row_counts(spark, db, expected).collect())
    r2 = load.load_all(spark, m, {**paths, "NOT_MODELLED": "/nonexistent"}, "orders.csv", db, location=loc)
    assert r2["status"] == "PARTIAL" and r2["run_id"] == 2
    r3 = load.load_all(spark, m, {"NOT_MODELLED": "/nonexistent"}, "orders.csv", db, location=loc)
    assert r3["status"] == "FAILED"
    runs = {r["RUN_ID"]: r["STATUS"] for r in audit.recent_runs(spark, db).collect()}
    assert runs == {1: "SUCCESS", 2: "PARTIAL", 3: "FAILED"}
    ids = [r["STATUS_ID"] for r in audit.recent_status(spark, db).collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    detail = audit.run_detail(spark, db, status="PARTIAL")
    assert detail["tables"].where("STATUS = 'FAILED'").count() == 1
    by_status = {r["STATUS"]: r["runs"] for r in audit.summary(spark, db).collect()}
    assert by_status == {"SUCCESS": 1, "PARTIAL": 1, "FAILED": 1}


def test_csv_load_rejects_go_to_errors_table(spark, tmpdir_path):
    rows = [(i, i % 3, f"c{i % 3}", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "order_id long, customer_id long, customer_name string, total_amount double")
    p = profile_table(df, "orders")
    m = infer_model(p, candidate_keys(p), "orders")
    tabs = split(df, m, "orders.csv", order_by="order_id")
    out = os.path.join(tmpdir_path, "csvout")
    summary = sinks.write_tables(spark, {"FACT_MAIN": tabs["FACT_MAIN"]}, out, fmt="csv").collect()
    path = summary[0]["path"]
    header = open(os.path.join(path, [f for f in os.listdir(path) if f.endswith(".csv")][0])).readline()
    with open(os.path.join(path, "late-arrival.csv"), "w") as f:  # a new file (appending would break checksums)
        f.write(header + "broken,row,with,too,many,fields,in,it,for,the,table,really\n")
    db = "sw_test_csv_errors"
    res = load.load_all(spark, m, {"FACT_MAIN": path}, "orders.csv", db, fmt="csv",
                        location=os.path.join(tmpdir_path, "wh2"))
    assert res["status"] == "SUCCESS"
    assert res["tables"][0]["rows_loaded"] == 30
    errors = audit.recent_errors(spark, db).collect()
    assert len(errors) == 1 and errors[0]["TABLE_NAME"] == "FACT_MAIN" and "broken" in errors[0]["REJECTED_ROW"]



def test_csv_na_tokens_and_inference(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "na.csv"),
               "id,amount,flag,when,note\n1,2.5,true,2024-01-02,NA\n2,NA,false,2024-01-03,x\n3,null,True,N/A,n/a\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"id": "int", "amount": "double", "flag": "boolean", "when": "string", "note": "string"}
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, 2.5, True, "2024-01-02", None), (2, None, False, "2024-01-03", "x"), (3, None, True, None, None)]


def test_codes_with_number_suffixes_stay_text(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "codes.csv"), "code,n\n10D,1\n20F,2\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"code": "string", "n": "int"} and [r["code"] for r in df.orderBy("n").collect()] == ["10D", "20F"]


def test_folder_of_mixed_layouts(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "mixed")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), 'id,name\n1,José\n2,"two\nlines, one row"\n')
    _write(os.path.join(d, "b.csv"), "id;name\n3;Málaga\n", encoding="latin-1")
    _write(os.path.join(d, "c.csv"), "id\tname\n4\tπ\n", encoding="utf-16")
    rows = sorted(tuple(r) for r in read_csv(spark, d).collect())
    assert rows == [(1, "José"), (2, "two\nlines, one row"), (3, "Málaga"), (4, "π")]


def test_unconvertible_rows_are_rejected_with_their_number(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "bad.csv"), "note,id\na,1\nb,x\nc,\nd,7D\ne,5,6\n")
    db = "sw_test_rejects"
    load.create_namespace(spark, db, os.path.join(tmpdir_path, "wh3"))
    spark.sql(f"CREATE TABLE {db}.t (id INT, note STRING, extra DOUBLE) USING parquet")
    res = load.copy_into(spark, p, db, "t", "csv")
    assert (res.rows_parsed, res.rows_loaded, res.errors_seen) == (5, 2, 3)
    assert {(r["id"], r["note"]) for r in spark.table(f"{db}.t").collect()} == {(1, "a"), (None, "c")}
    rejects = sorted((r["row_number"], r["error_message"]) for r in res.rejects.collect())
    assert rejects == [(2, "cannot convert: id"), (4, "cannot convert: id"), (5, "too many fields")]


def test_nested_arrays_below_the_first_level(spark):
    df = spark.createDataFrame([(1, ([("x", [1, 2]), ("y", [])],))], "id long, o struct<items:array<struct<s:string,tags:array<int>>>>")
    out = flatten_nested(df, ["id"])
    assert set(out) == {"parent", "o_items", "o_items_tags"}
    assert sorted(tuple(r)[1:] for r in out["o_items"].collect()) == [(1, 0, "x"), (1, 1, "y")]
    tags = out["o_items_tags"]
    assert tags.columns == ["PARENT_SK", "id", "o_items_pos", "pos", "o_items_tags"]
    assert sorted(tuple(r)[1:] for r in tags.collect()) == [(1, 0, 0, 1), (1, 0, 1, 2)]
