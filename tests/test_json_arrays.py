"""JSON arrays cut into splits give what one parser gives of the whole document."""

import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from starweave.sources import json_arrays, read_json


def _doc(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice('ab{}[]",:\\é \n') for _ in range(r.choice([0, 5, 60])))
    return [{"id": seed * 1000 + i, "s": text(), "list": [{"x": [i, {"t": text()}]}] * r.randrange(3), "o": {"}": text()}}
            for i in range(r.randrange(1, 40))]


@pytest.mark.parametrize("size", ["400", "134217728"])
def test_array_documents_in_splits(spark, tmpdir_path, size):
    docs = [_doc(k) for k in range(3)]
    for k, d in enumerate(docs):
        with open(os.path.join(tmpdir_path, f"{k}.json"), "w") as f:
            json.dump(d, f, indent=[None, 2, None][k], ensure_ascii=k == 0)
    with open(os.path.join(tmpdir_path, "3.json"), "w") as f:
        f.write("[ ]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if size == "400":
            assert json_arrays._stretches(spark, tmpdir_path).rdd.getNumPartitions() > 10
        got = {r["value"] for r in spark.read.text(json_arrays.json_objects(spark, tmpdir_path, limit=0 if size == "400" else 1 << 20)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda d: json.dumps(d, sort_keys=True)
    assert sorted(key(json.loads(x)) for x in got) == sorted({key(e) for d in docs for e in d})


def test_other_documents(spark, tmpdir_path):
    def read(name, text, code="utf-8"):
        p = os.path.join(tmpdir_path, name)
        with open(p, "w", encoding=code) as f:
            f.write(text)
        return sorted(tuple(r) for r in read_json(spark, p).collect())

    assert read("one.json", '{\n "a": 1,\n "b": "x"\n}\n') == [(1, "x")]
    assert read("bom.json", '﻿[{"a": 1}, null, 5, {"a": 2}]') == [(1,), (2,)]
    assert read("wide.json", '[{"a": 1}, {"a": 2}]', "utf-16") == [(1,), (2,)]
    with pytest.raises(ValueError):
        read("cut.json", '[{"a": 1}, {"a": 2')


@given(st.text(alphabet='{}[]"\\a', max_size=40), st.sampled_from([0, 1]))
@settings(max_examples=300, deadline=None)
def test_structure(text, in_string):
    data = np.frombuffer((text + "}").encode(), np.uint8)
    at, steps = json_arrays.Structure(data).outside(in_string)
    want, inside, skip = [], bool(in_string), False
    for i, c in enumerate(text + "}"):
        if skip:
            skip = False
            if c == '"':
                continue
        elif c == "\\":
            skip = True
            continue
        elif c == '"':
            inside = not inside
            continue
        if c in "{}[]" and not inside:
            want.append((i, 1 if c in "{[" else -1))
    assert list(zip(at.tolist(), steps.tolist())) == want
