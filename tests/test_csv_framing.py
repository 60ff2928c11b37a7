"""CSV folders: headers by file, records that cross splits, exact field counts."""

import csv
import io
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from starweave.plans import load
from starweave.sources import framing, read_csv
from starweave.sources.sniff import file_layouts, load_paths


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


@pytest.fixture()
def small_splits(spark):
    """Input splits of 700 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_go_by_each_files_header(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "1.csv"), "a,b\n1,2\n")
    _write(os.path.join(tmpdir_path, "2.csv"), "b,a\n3,4\n")
    _write(os.path.join(tmpdir_path, "3.csv"), "B;c\n5;six\n")
    _write(os.path.join(tmpdir_path, "4.csv"), "c,a\nx y,7\n8\n")
    df = read_csv(spark, tmpdir_path)
    assert df.columns == ["a", "b", "c"]
    assert _rows(df) == sorted([(1, 2, None), (4, 3, None), (None, 5, "six"), (7, None, "x y"), (None, None, "8")], key=repr)
    db = "sw_test_permuted"
    load.create_namespace(spark, db, os.path.join(tmpdir_path, "wh"))
    spark.sql(f"CREATE TABLE {db}.t (a INT, b INT) USING parquet")
    sub = os.path.join(tmpdir_path, "two")
    os.makedirs(sub)
    _write(os.path.join(sub, "1.csv"), "a,b\n1,2\n")
    _write(os.path.join(sub, "2.csv"), "b,a\n3,4\n")
    assert load.copy_into(spark, sub, db, "t", "csv").rows_loaded == 2
    assert _rows(spark.table(f"{db}.t")) == [(1, 2), (4, 3)]


def test_header_over_two_lines_and_odd_names(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "h.csv"), '﻿"a\nx",b,,b,B\n1,2,3,4,5\n')
    df = read_csv(spark, p)
    assert df.columns == ["a\nx", "b", "Unnamed: 2", "b.1", "B.2"] and _rows(df) == [(1, 2, 3, 4, 5)]
    p = _write(os.path.join(tmpdir_path, "n.csv"), '"1\n",2\n3,4\n')
    assert _rows(read_csv(spark, p, header=False, infer_types=False)) == [("1\n", "2"), ("3", "4")]


def test_field_count_is_exact(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "c.csv"), 'a,b\n1,2,,9\n3,4,\n5,6\n7\n"8,,,",9\n"x""",""\n1,"a"b,2\n5" pipe,3" x\n,\n,,\n')
    res = read_csv(spark, p, with_rejects=True, infer_types=False, na_values=())
    assert sorted(r["rejected_row"] for r in res.rejects.collect()) == sorted(["1,2,,9", "3,4,", '1,"a"b,2', ",,"])
    kept = sorted((r["a"] or "", r["b"] or "") for r in res.rows.collect())
    assert kept == sorted([("5", "6"), ("7", ""), ("8,,,", "9"), ('x"', ""), ('5" pipe', '3" x'), ("", "")])
    assert res.rejects.count() == 4 and res.rows.count() == 6  # counts alone give the same


def test_line_breaks_and_encodings(spark, tmpdir_path):
    for i, (text, code) in enumerate([("a,b\r\n1,x\r\n\r\n2,y", "utf-8"), ("b,a\rw,3\rv,4\r", "utf-8"), ('a,b\n5,"ü\r\nü"\n', "latin-1"),
                                      ('a\tb\n6,"€"\n7\t"one\ntwo"\n', "utf-16"), ('b,a\r"p\rq",8\r', "utf-8")]):
        _write(os.path.join(tmpdir_path, f"{i} [x]{{y}} %20.csv"), text, code)
    want = [("1", "x"), ("2", "y"), ("3", "w"), ("4", "v"), ("5", "ü\r\nü"), ('6,"€"', ""), ("7", "one\ntwo"), ("8", "p\nq")]
    got = [(r["a"] or "", r["b"] or "") for r in read_csv(spark, tmpdir_path, infer_types=False, na_values=()).collect()]
    assert sorted(got) == sorted(want)


def _random_csv(seed, stray=False):
    r = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    rows = [["id", "text", "more,\nof it" if seed % 2 else "more"]]
    for i in range(r.randrange(5, 60)):
        text = "".join(r.choice('ab,;"\n é') for _ in range(r.choice([0, 3, 20, 350, 900])))
        rows.append([str(i), text, r.choice(["", "x", '"', "\n", "1;2"])])
    w.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("seed", range(2))
def test_records_across_splits(spark, tmpdir_path, small_splits, seed):
    """Random files cut into small splits give the rows that Python's own reader gives of the whole file."""
    want = []
    for k in range(2):
        text, rows = _random_csv(10 * seed + k)
        _write(os.path.join(tmpdir_path, f"f{k}.csv"), text)
        names = ["id", "text", "more,\nof it", "more"]
        want += [tuple(dict(zip(rows[0], row)).get(n) or None for n in names) for row in rows[1:]]
    df = read_csv(spark, tmpdir_path, infer_types=False, na_values=("",))
    got = [tuple(r[n] if n in df.columns else None for n in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert framing.text_lines(spark, tmpdir_path).rdd.getNumPartitions() > 4


def test_one_record_over_many_splits(spark, tmpdir_path, small_splits):
    long = "\n".join(f"line {i}, with \"quotes\" and, commas" for i in range(90))
    p = os.path.join(tmpdir_path, "long.csv")
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows([["id", "t"], [1, "x"], [2, long], [3, long + "\n"], [4, "y\nz"]])
    got = {r["id"]: r["t"] for r in read_csv(spark, p).collect()}
    assert got == {1: "x", 2: long, 3: long + "\n", 4: "y\nz"}
    inside = framing.inside_blocks(file_layouts(spark, p).blocks)
    assert inside.count() > 5
    lines = framing.text_lines(spark, p)
    order = lambda df: sorted((r["block"], r["ordinal"], bytes(r["record"])) for r in df.collect())
    assert order(framing.frame(lines, inside, ",")) == order(framing.frame(lines, inside, ",", limit=0))  # dealt out and sorted


def test_rejects_have_their_row_numbers_over_splits(spark, tmpdir_path, small_splits):
    lines = ["id,note"] + [f'{i},"a\nb{i}"' if i % 3 else f"{i},x,y" for i in range(1, 61)]
    p = _write(os.path.join(tmpdir_path, "r.csv"), "\n".join(lines) + "\n")
    db = "sw_test_split_rejects"
    load.create_namespace(spark, db, os.path.join(tmpdir_path, "wh4"))
    spark.sql(f"CREATE TABLE {db}.t (id INT, note STRING) USING parquet")
    res = load.copy_into(spark, p, db, "t", "csv")
    assert (res.rows_parsed, res.rows_loaded) == (60, 40)
    assert sorted((r["row_number"], r["rejected_row"]) for r in res.rejects.collect()) == [(i, f"{i},x,y") for i in range(3, 61, 3)]


def test_quotes_after_other_delimiters(spark, tmpdir_path, small_splits):
    """A quote after a semicolon opens no field in a file of commas, and the other way round."""
    _write(os.path.join(tmpdir_path, "a.csv"), "a,b\n" + 'x;"1,2\n' * 30 + '"p\nq",3\n')
    _write(os.path.join(tmpdir_path, "b.csv"), "a;b\n" + 'x,"y;5\n' * 30 + '"p;\nq";6\n')
    got = _rows(read_csv(spark, tmpdir_path))
    assert got == sorted([('x;"1', 2)] * 30 + [("p\nq", 3)] + [('x,"y', 5)] * 30 + [("p;\nq", 6)], key=repr)


def test_empty_inputs(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "e.csv"), "")
    assert read_csv(spark, tmpdir_path).collect() == []
    _write(os.path.join(tmpdir_path, "f.csv"), "\n\na,b\n")
    df = read_csv(spark, tmpdir_path)
    assert df.columns == ["a", "b"] and df.collect() == []


@given(st.text(alphabet='ab,";\n', max_size=60), st.sampled_from([0, 1]))
@settings(max_examples=300, deadline=None)
def test_course_of_quotes(text, state):
    """Both courses, computed together, agree with reading character by character."""
    data = np.frombuffer((text + "\n").encode(), np.uint8)
    course = framing.Course(data, b",")
    (fast,), ends = course.run((state,)), np.arange(len(data) + 1)
    slow, now, at_start, i, s = [], state, True, 0, text + "\n"
    while i < len(s):
        c = s[i]
        if now and c == '"' and s[i + 1:i + 2] == '"':
            slow += [1, 1]
            i += 2
            continue
        if c == '"':
            now, at_start = (0, False) if now else (int(at_start), False)
        elif not now:
            at_start = c in ",\n"
        slow.append(now)
        i += 1
    breaks = [k for k, c in enumerate(s) if c == "\n"]
    assert [int(course.open_at(fast, ends[k + 1:k + 2])[0]) for k in breaks] == [slow[k] for k in breaks]


def test_paths_of_files_with_odd_names():
    assert load_paths(["file:/a%20b/c[1]{x}*.csv"]) == ["file:/a b/c\\[1\\]\\{x\\}\\*.csv"]
