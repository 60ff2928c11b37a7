"""Fill-in-middle, vector codes and exact top-k against plain Python, over odd rows and the parts of their methods."""

import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from starweave.llm import exact_topk, fill_in_middle, queries as Q, vector_codes  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
NAMES = ("n", "form", "output", "prefix_chars", "id", "text_", "h1", "digest", "v", "uid", "code", "error", "size", "rank", "score",
         "query_id", "nearest", "a.b")


def clashing(df):
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def random_vectors(seed, n, size=64):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).tolist()


# fill-in-middle

def test_registered_middle(spark):
    import duckdb

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r[0]: tuple(r)[1:] for r in Q.op11_fill_in_middle(spark, SF).collect()}
    want = {i: brute.fill_in_middle(i, t) for i, t in texts.items()}
    assert got == {i: (*w[:4], sha(w[4]), sha(texts[i] or "")) for i, w in want.items()}
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}


def test_middle_of_odd_rows(spark):
    r = random.Random(3)
    odd = [None, "", " ", "a", "é", "aé", "éa b", "<P> here", "half a mark <P", "S> <M", "\u0000x\u0000", "日本語 text 漢字", "x" * 70_000,
           "ab " * 90_000, "\r\n\t", "ÀÉz", "🙂a🙂", "KK", "<", "<<S", ">"]
    odd += ["".join(r.choice("aZé🙂 \n9<>PSM") for _ in range(r.randrange(40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(5, "again"), (5, "again"), (None, "no id"), (-7, "a negative id"), (None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = fill_in_middle.transform(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form")))
    key = lambda x: repr(x)
    got = sorted((tuple(x) for x in out.collect()), key=key)
    assert got == sorted(((i, *brute.fill_in_middle(i, t), t or "") for i, t in rows), key=key)
    small = fill_in_middle.transform(docs, settings=fill_in_middle.Settings(block_bytes=64)).collect()
    assert sorted((tuple(x) for x in small), key=key) == sorted((x[:-1] for x in got), key=key)
    assert fill_in_middle.transform(docs.limit(0)).collect() == []


def test_middle_of_text_ids_and_other_marks(spark):
    s = fill_in_middle.Settings(prefix="[a|b]", suffix="(.*)", middle="\\E", plain_from=101, spm_below=50)
    docs = spark.createDataFrame([(f"d{i}", "one two [a|b" + " three" * i) for i in range(40)], "doc_id string, text string")
    out = fill_in_middle.transform(docs, settings=s)
    rows = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), s)).join(docs, "doc_id").collect()
    assert len(rows) == 40 and all(r["back"] == r["text"] for r in rows) and {r["form"] for r in rows} == {"psm", "spm"}


@given(st.lists(st.integers(0, 7), max_size=400))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix_ranks(sequence):
    matrix = fill_in_middle.WaveletMatrix(np.array(sequence, np.uint8))
    at = np.arange(len(sequence) + 1)
    for value in range(8):
        assert matrix.rank(value, at).tolist() == [sequence[:i].count(value) for i in at]


@given(st.lists(st.text(alphabet="aB é🙂\n1-", max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_cuts_by_bisection(texts):
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    starts = ends - [len(d) for d in data]
    matrix = fill_in_middle.WaveletMatrix(fill_in_middle.classes(np.frombuffer(b"".join(data), np.uint8), starts))
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert (matrix.units(ends) - matrix.units(starts)).tolist() == [len(u) for u in units]
    for count in range(max(len(u) for u in units) + 1):
        wanted = np.array([min(count, len(u)) for u in units])
        cuts = matrix.after_units(wanted, starts, ends) - starts
        assert cuts.tolist() == [len("".join(u[:c]).encode()) for u, c in zip(units, wanted)]


# vector codes

def odd_vectors():
    v = random_vectors(5, 120)
    rows = [(i * 3, x, i % 4 if i % 5 else None) for i, x in enumerate(v)]
    rows += [(1, None, 0), (2, [None] + v[0][1:], 1), (4, [math.nan] + v[0][1:], 1), (5, [math.inf] + v[0][1:], None), (7, [], 2),
             (8, v[0], 9), (10, v[0], 9), (11, [0.0] * 64, None), (13, [-x for x in v[1]], 0), (14, [3.9] * 64, 5)]
    random.Random(1).shuffle(rows)
    return rows


def codes(df):
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in df.collect())


def test_codes_of_odd_rows(spark):
    rows = odd_vectors()
    frame = clashing(spark.createDataFrame(rows, VECTORS))
    out = vector_codes.compress(frame)
    want, digest = brute.vector_codes(rows)
    assert codes(out) == want and {r["codebooks_sha256"] for r in out.collect()} == {digest}
    assert codes(vector_codes.compress(frame.repartition(7))) == want  # no order of rows matters
    assert codes(vector_codes.compress(frame, limit=0)) == want  # labels joined by a shuffle
    few = vector_codes.Settings(cells=1, block=16)  # the cache is emptied all the time
    assert codes(vector_codes.compress(frame, settings=few)) == want


def test_codes_of_few_or_no_vectors(spark):
    rows = [(i, x, None) for i, x in enumerate(random_vectors(8, 5))]
    assert codes(vector_codes.compress(spark.createDataFrame(rows, VECTORS))) == brute.vector_codes(rows)[0]
    empty = spark.createDataFrame([(1, None, 3), (2, [math.nan], 3)], VECTORS)
    for df in (empty, empty.limit(0)):
        out = vector_codes.compress(df)
        assert out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_repeated_and_uneven_rows(spark):
    """Equal rows get equal codes; a null id comes last; other lengths are left out; 10 components are filled up to 16."""
    v = random_vectors(9, 40, 10)
    rows = [(i // 2, x, 1) for i, x in enumerate(v)] + [(None, v[3], 1), (3, v[3], 1), (99, v[3][:9], 1)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 42 and {len(r["code"]) for r in got} == {16}
    twins = {r["code"] for r in got if r["vec_id"] is None} | {r["code"] for r in got if r["vec_id"] == 3}
    assert {r["code"] for r in got if r["vec_id"] is None} <= twins and all(r["label_error"] == sum(x["error"] for x in got) for r in got)


@given(st.integers(0, 10_000), st.integers(1, 16), st.integers(1, 9), st.sampled_from([0.25, 1.0, 4.0]))
@settings(max_examples=40, deadline=None)
def test_cells_never_lose_the_nearest_entry(seed, entries, width, diagonal):
    rng = np.random.default_rng(seed)
    book = rng.integers(-60, 60, (entries, width))
    parts = rng.integers(-90, 90, (200, width))
    cache = vector_codes.CellCache(book, vector_codes.Settings(diagonal=diagonal, cells=50))
    apart = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    index, best = cache.nearest(parts)
    assert index.tolist() == apart.argmin(axis=1).tolist() and best.tolist() == apart.min(axis=1).tolist()


def test_cells_spare_evaluations():
    """In data with clusters the cache answers for most parts and leaves few entries to evaluate."""
    rng = np.random.default_rng(2)
    book = rng.integers(-4000, 4000, (16, 8))
    parts = book[rng.integers(0, 16, 20_000)] + rng.integers(-200, 200, (20_000, 8))
    cache = vector_codes.CellCache(book, vector_codes.Settings())
    cache.nearest(parts)
    assert cache.evaluated < 2 * len(parts) and cache.missed < len(parts) / 5


# exact top-k

def ranked(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_topk_of_odd_rows(spark):
    rows = [(i, x) for i, x, _ in odd_vectors()]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (-40, rows[2][1]), (500, [0.0] * 64)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sorted(brute.top_k(rows), key=repr)
    every = F.col("id") % 20 == 0
    assert ranked(exact_topk.search(frame, every)) == want
    many = exact_topk.Settings(group_bytes=4096, block=16, chunk=3, step=5, pivots=7, sample=30)
    assert ranked(exact_topk.search(frame.repartition(5), every, settings=many)) == want


def test_topk_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    every = F.col("id") % 20 == 0
    few = [(20 * i, x) for i, x in enumerate(random_vectors(4, 4))]
    assert ranked(exact_topk.search(spark.createDataFrame(few, schema), every)) == sorted(brute.top_k(few), key=repr)
    for rows in ([], [(20, None), (40, [math.nan])], [(1, [1.0]), (2, [2.0])], [(20, [1.0])]):
        out = exact_topk.search(spark.createDataFrame(rows, schema), every)
        assert out.collect() == [] and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_with_ties_everywhere(spark):
    rows = [(i, [0.5, -0.25, 0.0, 0.75]) for i in range(400)]
    got = ranked(exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0))
    assert got == sorted(brute.top_k(rows), key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_elimination_is_exact_and_works_on_clusters(spread):
    """Search of one block after the other; rows of far clusters are not evaluated."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    vectors = np.floor(64 * (centres[np.arange(4000) % 20] + spread * rng.normal(size=(4000, 16)) / 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors = np.floor(vectors * 512)
    uid = np.arange(4000)
    pivots = vectors[exact_topk.choose_pivots(vectors[:500], 24)]
    away = exact_topk.distances(vectors, pivots)
    order = np.argsort(away.argmin(axis=1), kind="stable")
    queries = uid[::100]
    group = exact_topk.Group(queries, vectors[queries], away[queries], np.full(len(queries), -np.inf), 20)
    for at in range(0, 4000, 250):
        rows = order[at:at + 250]
        group.search(uid[rows], uid[rows], vectors[rows], away[rows], 16, 64)
    for n, q in enumerate(queries):
        scores = vectors @ vectors[q]
        best = [i for i in np.lexsort((uid, -scores)) if i != q][:20]
        assert group.best[n][1].tolist() == best
    if spread < 0.1:
        assert group.evaluated < 0.35 * len(queries) * 4000
