"""The registered queries over whole tables against plain Python or SQL."""

import hashlib
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from starweave.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def test_minhash(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in Q.op1_minhash_dedup(spark, SF).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.components(docs).items()}


def test_decontamination(spark, docs, con):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op2_decontaminate(spark, SF).collect()}
    assert got == brute.contamination(docs, items)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, con, name):
    got, exp = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    rows = lambda d: sorted(repr([None if v is None or v != v else v for v in r])
                            for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(exp)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op4_quality_model(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1) == got.held_out).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_packing_round_trip(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in docs}
    got = Q.op5_packing(spark, SF).toPandas()
    for doc, pieces in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for r in pieces.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert zlib.crc32(ids[doc][at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc])
    assert set(got.doc_id) == set(ids)
    lengths = []
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert (pieces.offset == pieces.length.cumsum() - pieces.length).all()
        lengths.append(int(pieces.length.sum()))
    assert max(lengths) <= 2048
    padded = [n if n & (n - 1) == 0 else 2048 for n in lengths]
    assert sum(lengths) / sum(padded) > 0.99


def test_url_rules(spark, con):
    import re

    from starweave.llm.url_filter import RULES

    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    got = Q.op6_url_filter(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [x for x in RULES if (host.lower() == x[0] or host.lower().endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["host"], r["path"]) == (host.lower(), path)
        assert r["rule"] == (best and best[0] + best[1]) and r["verdict"] in ("allow", "block")
        assert best is None or r["verdict"] == best[2]
    order = sorted(urls)
    want = dict(zip(order, brute.url_verdicts([urls[i] for i in order], RULES)))
    assert {r["page_id"]: (r["template"], r["verdict"]) for r in got} == want


def test_token_rollup(spark, con):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, revised = {}, 0
    for doc, text, lang, source in con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall():
        if doc % 10 > 1:
            n, t = want.get((source, lang), (0, 0))
            want[(source, lang)] = n + 1, t + len(plain.encode(text or "", add_special_tokens=False).ids)
        revised += doc % 10 == 1
    rows = Q.op8_token_rollup(spark, SF).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rows if r["tokenizer"] == "byte_bpe_50k"} == want
    assert sum(r["n_docs"] for r in rows if r["tokenizer"] == "byte_bpe_multi_50k") == revised


def test_quality_rules(spark, docs, con):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op9_quality_rules(spark, SF).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    assert {i: v[:6] for i, v in got.items()} == {i: brute.quality_counts(t) for i, t in docs}
    assert not any(v[5] and v[6] for v in got.values())
    good = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    judged = [(good[i], v[6]) for i, v in got.items() if i in good and not v[5]]
    assert all(kept for quality, kept in judged if quality) and not any(kept for quality, kept in judged if not quality)


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op10_line_dedup(spark, SF).collect()}
    assert got == {i: (n, d, hashlib.sha256(x.encode()).hexdigest()) for i, x, n, d in brute.line_dedup(docs)}
