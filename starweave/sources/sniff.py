"""Source checks and sniffing, as Spark jobs over any number of files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from starweave.session import written
from starweave.sources import framing

def file_layouts(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                 multi_line: bool | None = None, header: bool = True) -> DataFrame:
    """(file_path, encoding, delimiter, multi_line, names) and more of every text file below ``path``, from one pass.

    The encoding is UTF-16 with a byte-order mark, UTF-8 if every line is valid UTF-8, else Latin-1. The delimiter is the
    first known one of the first record. ``multi_line`` tells whether a quoted field holds a line break; ``names`` are the
    columns of the file's own header (or numbers, without ``header``). ``whole``: the file cannot be read in splits. Given
    options replace what would be found. Files without a record are left out.

    The result is a written table; its attribute ``blocks`` are the summaries of the files' blocks (see ``framing``).
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path")).withColumn(
        "key", F.xxhash64("file_path"))  # a listing, without contents
    lines = framing.text_lines(spark, path)
    if encoding is not None and multi_line is False:
        lines = lines.filter(F.col("block") == 0)  # only headers are wanted
    blocks = written(framing.summarise(lines, sep, header), "csv-blocks")
    found = written(_per_file(files, blocks, sep, encoding), "csv-files")

    # a quote after another of the delimiters than the file's own opens no field: those files are summarised anew
    own = F.coalesce(*[F.when(F.col("delimiter") == d, 1 << i) for i, d in enumerate(framing.DELIMITERS)], F.lit(0))
    doubtful = found.filter(~F.col("whole") & F.col("multi_line") & (F.col("mask").bitwiseAND(F.bitwise_not(own)) != 0)) if sep is None else None
    again = [] if doubtful is None else doubtful.groupBy("delimiter").agg(F.collect_list("file_path").alias("paths")).collect()
    for g in again:
        exact = written(framing.summarise(framing.text_lines(spark, load_paths(g["paths"])), g["delimiter"], header), "csv-blocks")
        blocks = blocks.join(F.broadcast(exact.select("key").distinct()), "key", "left_anti").unionByName(exact)
    wholes = found.filter("whole").groupBy("encoding").agg(F.collect_list("file_path").alias("paths")).collect()
    for g in wholes:
        exact = written(framing.summarise(framing.decoded_lines(spark, load_paths(g["paths"]), g["encoding"]), sep, header), "csv-blocks")
        blocks = blocks.join(F.broadcast(exact.select("key").distinct()), "key", "left_anti").unionByName(
            exact.withColumn("wide", F.lit(g["encoding"] == "utf-16")).withColumn("cr", F.lit(True)).withColumn("open", F.lit(True)))
    if again or wholes:
        found = written(_per_file(files, blocks, sep, encoding), "csv-files")
    if multi_line is not None:
        found = found.withColumn("multi_line", F.lit(multi_line))
    found.blocks = blocks
    return found


def _per_file(files: DataFrame, blocks: DataFrame, sep: str | None, encoding: str | None) -> DataFrame:
    one = blocks.groupBy("key").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("wide").alias("wide"), F.bool_or("cr").alias("cr"), F.bool_or("open").alias("open"),
        F.bit_or("mask").alias("mask"), F.max("delimiter").alias("delimiter"), F.first("names", True).alias("names"))
    one = one.filter(F.col("names").isNotNull() | F.col("wide"))
    if encoding is None:
        code = F.when(F.col("wide"), "utf-16").when(F.col("utf8"), "utf-8").otherwise("iso-8859-1")
    else:
        code = F.lit(encoding.lower())
    one = one.withColumn("encoding", code)
    wide = F.startswith("encoding", F.lit("utf-16"))
    latin = F.col("encoding").isin("iso-8859-1", "latin-1", "latin1")
    text = lambda n: F.when(latin, F.decode(n, "ISO-8859-1")).otherwise(n.cast("string"))
    return files.join(one, "key").select(
        "file_path", "key", "encoding", (F.lit(sep) if sep is not None else F.coalesce("delimiter", F.lit(framing.DEFAULT_DELIMITER))).alias("delimiter"),
        (F.col("open") | wide).alias("multi_line"), (wide | (F.col("cr") & F.col("open"))).alias("whole"), "mask",
        F.transform(F.coalesce("names", F.array()), text).alias("names"))


def load_paths(file_paths: list[str]) -> list[str]:
    """File paths as Spark reports them (URI-encoded) in the form that readers take."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in file_paths]


def sniff_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, delimiter) for every file below ``path``."""
    return file_layouts(spark, path).select("file_path", "delimiter")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter of the first file (by path order)."""
    row = file_layouts(spark, path).orderBy("file_path").first()
    return row["delimiter"] if row else framing.DEFAULT_DELIMITER


def sniff_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, encoding) for every file below ``path``."""
    return file_layouts(spark, path).select("file_path", "encoding")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """Encoding of the first file (by path order)."""
    row = file_layouts(spark, path).orderBy("file_path").first()
    return row["encoding"] if row else "utf-8"


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, size_bytes, size_mb, modified_time) without reading file contents."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        F.col("modificationTime").alias("modified_time"),
    )


def validate_source(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[bool, str | None]:
    """(ok, message): the path exists (on whichever file system it names), the format is supported and a first row can
    be read. Types are not inferred."""
    from starweave.sources.readers import SUPPORTED_FORMATS, format_from_path, read_any

    fmt = (fmt or format_from_path(path)).lower()
    try:
        spark.read.format("binaryFile").load(path)  # resolves the path only
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return False, "File does not exist"
        return False, f"File validation failed: {exc}"
    if fmt not in SUPPORTED_FORMATS:
        return False, f"Unsupported file type: {fmt}"
    try:
        read_any(spark, path, fmt, **({"infer_types": False} if fmt == "csv" else {})).limit(1).collect()
    except Exception as exc:  # noqa: BLE001 - the message is the result
        return False, f"File validation failed: {exc}"
    return True, None
