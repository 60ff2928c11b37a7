"""Registered queries of the training-data operators and their SQL (DuckDB) where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starweave.llm import (decontaminate, exact_topk, fill_in_middle, licences, line_dedup, minhash, packing, quality_model,
                           quality_rules, token_rollup, url_filter, vector_codes, warc_merkle)
from starweave.llm.common import materialize, new_scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and a digest of the items found."""
    found = decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


FILE_PAGES = 1000


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of ``pages`` as WARC files: bodies changed, records lost, records added.

    The pages are response records, ``FILE_PAGES`` page ids to a file, one after the other. The replica is derived from
    them: page ids that leave 5 when divided by 97 lose the last character of their body to a ``~`` (or get one), those
    that leave 7 with 101 are lost, and those that leave 11 with 103 come once more a gibibyte further on.
    """
    pages = _read(spark, sf_dir, "pages")
    body = F.coalesce("html", F.lit(""))
    shorter = F.expr("left(coalesce(html, ''), greatest(char_length(coalesce(html, '')) - 1, 0))")
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(shorter, F.lit("~"))).otherwise(body)
    file = F.format_string("pages-%06d.warc", F.floor(F.col("page_id") / FILE_PAGES)).alias("file")
    ours = warc_merkle.with_digest(pages.select("page_id", file, warc_merkle.warc_record(F.col("url"), body).alias("payload"),
                                                warc_merkle.warc_record(F.col("url"), damaged).alias("other")))
    both = warc_merkle.with_digest(ours.withColumnsRenamed({"length": "own_length", "digest": "own_digest"}), "other")
    # offsets from the lengths alone: bodies stay where they are read
    before = Window.partitionBy("file").orderBy("page_id", "own_digest").rowsBetween(Window.unboundedPreceding, -1)
    both = materialize(both.withColumn("offset", F.coalesce(F.sum("own_length").over(before), F.lit(0))), "records")
    ours = both.select("page_id", "file", "offset", F.col("own_length").alias("length"), F.col("own_digest").alias("digest"))
    theirs = both.filter(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True))).select("page_id", "file", "offset", "length", "digest")
    again = ours.filter(F.col("page_id") % 103 == 11).withColumn("offset", F.col("offset") + (1 << 30))
    found = warc_merkle.audit(warc_merkle.record_hashes(ours, payload_col=None),
                              warc_merkle.record_hashes(theirs.unionByName(again), payload_col=None))
    places = ours.unionByName(again).select("page_id", F.col("file").alias("p_file"), F.col("offset").alias("p_offset"))
    out = found.join(places, F.col("file").eqNullSafe(F.col("p_file")) & (F.col("offset") == F.col("p_offset")))
    return out.select("page_id", "file", "offset", "kind")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out third."""
    return quality_model.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, listed rule and verdict of every page's url."""
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document, the licence it is and the notices it has."""
    return licences.scan(_read(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer after inserts, deletes, revisions and repeated commits.

    All documents are inserted with their counts under one tokenizer; those whose id leaves 0 when divided by 10 are
    deleted, and those that leave 1 are counted anew under another tokenizer. Batches 2 and 3 are committed twice.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("multi", F.coalesce(F.col("doc_id") % 10 == 1, F.lit(False)))
    counts = materialize(token_rollup.count_tokens(docs, "text", {
        "plain": packing.public_tokenizer(), "multi": packing.public_tokenizer("byte_bpe_multi_50k", special=())}), "counts")
    store = token_rollup.Rollup(spark, new_scratch(spark, "rollup"))
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    store.apply("1-insert", token_rollup.signed(counts, 1, old, "plain"))
    deleted = token_rollup.signed(counts.filter(F.col("doc_id") % 10 == 0), -1, old, "plain")
    revised = counts.filter(F.col("doc_id") % 10 == 1)
    changes = token_rollup.signed(revised, -1, old, "plain").unionByName(token_rollup.signed(revised, 1, new, "multi"))
    for _ in range(2):
        store.apply("2-delete", deleted)
        store.apply("3-revise", changes)
    return store.totals()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and robust outlier verdict of every document."""
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after dropping repeated ones, and a digest of the kept text."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form and lengths of every document's fill-in-middle text, its digest and that of the text rebuilt from it."""
    out = fill_in_middle.transform(_read(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored, 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label and a digest of the codebooks."""
    out = vector_codes.compress(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


TOP_K_EVERY = 20


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by inner product for every vector whose id is divisible by ``TOP_K_EVERY``."""
    return exact_topk.search(_read(spark, sf_dir, "embeddings"), F.col("id") % TOP_K_EVERY == 0)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc_audit": op3_warc_audit,
    "op4_quality_model": op4_quality_model,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_licence_scan": op7_licence_scan,
    "op8_token_rollup": op8_token_rollup,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_topk": op13_exact_topk,
}

_OP3_SQL = f"""
WITH r AS (
  SELECT page_id, printf('pages-%06d.warc', CAST(floor(page_id / {FILE_PAGES}) AS BIGINT)) AS file,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ')
         + strlen(coalesce(url, '')) + 2 + strlen('Content-Length: ')
         + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
o AS (SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, file, "offset", 'missing' AS kind FROM o WHERE page_id % 101 = 7
UNION ALL SELECT page_id, file, "offset", 'changed' FROM o WHERE page_id % 97 = 5 AND page_id % 101 <> 7
UNION ALL SELECT page_id, file, "offset" + 1073741824, 'extra' FROM o WHERE page_id % 103 = 11
"""

_OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
c AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one,
         CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS pre,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS mid,
         array_to_string(units[greatest(one, two) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS DOUBLE) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS DOUBLE) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _op12_sql(s: vector_codes.Settings = vector_codes.Settings()) -> str:
    """Lloyd's rounds written out: one component a row, one common table expression for each codebook and assignment."""
    def assigned(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT r, part, min(d * {s.entries} + entry) % {s.entries} AS entry, min(d) AS d
  FROM (SELECT r, part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c USING (part, place) GROUP BY ALL)
  GROUP BY ALL)"""

    def moved(k: int) -> str:
        return f"""
c{k} AS MATERIALIZED (
  SELECT part, entry, place, coalesce(m.v, c.v) AS v FROM c{k - 1} c LEFT JOIN (
    SELECT part, entry, place, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM x JOIN a{k - 1} USING (r, part) GROUP BY ALL) m USING (part, entry, place))"""

    rounds = ",".join(assigned(k) + "," + moved(k + 1) for k in range(s.rounds)) + "," + assigned(s.rounds)
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({s.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT r, i // (n // {s.parts}) AS part, i % (n // {s.parts}) AS place, v
  FROM (SELECT r, len(v) AS n, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM k)),
c0 AS MATERIALIZED (SELECT part, r AS entry, place, v FROM x WHERE r < {s.entries}),{rounds},
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{s.rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{s.rounds}) AS codebooks_sha256
FROM k JOIN f USING (r)
"""


_OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * CAST(e AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {TOP_K_EVERY} = 0)
WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op3_warc_audit": _OP3_SQL,
    "op7_licence_scan": licences.oracle(),
    "op11_fill_in_middle": _OP11_SQL,
    "op12_vector_codes": _op12_sql(),
    "op13_exact_topk": _OP13_SQL,
}
