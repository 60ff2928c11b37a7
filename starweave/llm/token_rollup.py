"""Token counts: totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is a signed row: an insert adds a document's tokens, a delete takes them away, a revision takes the old count
away and adds the new one (also under another tokenizer version, source or language). A batch of changes is summed by
key before it is written, so the store grows with keys and batches, not with documents, and totals are plain sums.

Commits are idempotent: a batch writes its sums under a name of its own attempt, then a one-row commit record names that
attempt. A batch whose record exists is not applied again, and sums of attempts that no record names are never read, so a
job that fails or is run twice changes nothing. ``compact`` folds committed batches into one. One writer at a time.

Cases: null source, language or tokenizer is a key of its own; null token counts count as 0; an empty batch commits and
changes nothing; keys whose documents and tokens are both 0 are left out of the totals; negative totals are shown as
they are (a delete of what was never inserted); extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.llm.common import ship

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, docs long, tokens long, attempt string"
_COMMITS = "batch string, attempt string, folded array<string>"


def count_tokens(docs: DataFrame, text_col: str, tokenizers: dict[str, Callable[[], Callable[[str], bytes]]],
                 width: int = 4) -> DataFrame:
    """``docs`` without its text, with a column of token counts for each tokenizer (null text has none).

    ``tokenizers``: column to a maker of a function from text to ids of ``width`` bytes each. A column is counted only
    where the input has a boolean column of that name that is true, or no such column.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col and c not in tokenizers]
    flags = [c for c in tokenizers if c in docs.columns]
    narrow = docs.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"`{c}`").alias(f"__do_{c}") for c in flags],
                         F.col(f"`{text_col}`").alias("__text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:len(others)]),
                        *(f"`{c}` long" for c in tokenizers)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {c: make() for c, make in tokenizers.items()}
        for batch in batches:
            texts = batch.column("__text")
            counts = []
            for c, encode in encoders.items():
                wanted = batch.column(f"__do_{c}").to_pylist() if c in flags else [True] * batch.num_rows
                counts.append(pa.array([len(encode(t.as_py() or "")) // width if w else None for t, w in zip(texts, wanted)],
                                       pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *counts], names=[*others, *tokenizers])

    return narrow.mapInArrow(rows, fields)


def signed(docs: DataFrame, sign: int, tokenizer: str, tokens_col: str) -> DataFrame:
    """Changes (source, lang, tokenizer, sign, tokens) that add (1) or take away (-1) the given documents."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"),
                       F.col(f"`{tokens_col}`").alias("tokens"))


class Rollup:
    """A store of batch sums below ``path`` (a folder that the driver and all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.sums, self.commits = spark, f"{path}/sums", f"{path}/commits"

    def _read(self, path: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _live(self) -> DataFrame:
        """Commit records that no later fold has replaced."""
        records = self._read(self.commits, _COMMITS)
        folded = records.select(F.explode("folded").alias("gone")).distinct()
        return records.join(folded, records["attempt"] == folded["gone"], "left_anti")

    def is_committed(self, batch: str) -> bool:
        return not self._read(self.commits, _COMMITS).filter(F.col("batch") == batch).isEmpty()

    def _commit(self, batch: str, sums: DataFrame, folded: list[str]) -> None:
        attempt = uuid.uuid4().hex
        sums.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(self.sums)
        record = self.spark.createDataFrame([(batch, attempt, folded)], _COMMITS)
        record.coalesce(1).write.mode("append").parquet(self.commits)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes of ``batch``; False (and no effect) if it has been committed before."""
        if self.is_committed(batch):
            return False
        sums = changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
            F.sum("sign").cast("long").alias("docs"),
            F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        self._commit(batch, sums, [])
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches."""
        live = self._live().select(F.col("attempt").alias("live"))
        sums = self._read(self.sums, _SUMS)
        out = sums.join(live, sums["attempt"] == live["live"], "left_semi").groupBy(*KEYS).agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self, name: str) -> None:
        """Replace the live batches by one with their sums; batch names stay known, so they cannot be applied again."""
        if self.is_committed(name):
            return
        attempts = [r["attempt"] for r in self._live().select("attempt").collect()]  # one per batch since the last fold
        totals = self.totals().withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"})
        self._commit(name, totals, attempts)
