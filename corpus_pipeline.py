"""Corpus pipeline: the operators chained over ``documents``; each stage's result is written and read again.

Every stage but the last returns the columns of its input. A stage works on all that its predecessor kept. Rows with
null, empty or repeated ids and texts are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from starweave.llm.common import new_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the outlier rule keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in a later document; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    dropped = F.col(f"`{out.columns[-1]}`")
    length = F.when(dropped > 0, F.char_length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
