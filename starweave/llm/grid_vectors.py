"""Vectors as whole numbers: what code compression and top-k search read, written once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starweave.llm.common import materialize, ship

LARGEST = 1 << 30


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` items each from the items one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                 pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def unpacked(column: pa.Array, dtype: str) -> np.ndarray:
    """The items of a binary column whose values all have the same length, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _floors(scale: int, total: int):
    """``total``: the sum of squares over a vector that the caller's arithmetic still holds exactly."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            most = np.minimum(np.sqrt(total / np.maximum(sizes, 1)), LARGEST)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(invalid="ignore", over="ignore"):
                numbers = np.floor(flat * scale)
                bad = ~(np.abs(numbers) <= most[owner])  # also true for NaN
            good = (np.bincount(owner[bad], minlength=len(sizes)) == 0) & (sizes > 0)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(keep) for c in batch.schema.names if c != "v"), pa.array(sizes[good], pa.int32()),
                 packed(numbers[good[owner]].astype("<i4"), sizes[good])],
                names=[*(c for c in batch.schema.names if c != "v"), "size", "v"])

    return rows


def whole_vectors(rows: DataFrame, scale: int, total: int, name: str) -> tuple[DataFrame, int]:
    """(table, size): columns of ``rows`` but with the vector ``v`` as little-endian 32-bit numbers floor(``scale`` * x).

    Vectors that are null or empty, or hold null or non-finite components, are left out, as are those with components so
    large that sums of squares would pass ``total`` (for 64 components of embeddings: beyond 10,000 and more). All vectors
    kept have the most frequent length (the larger one of two as frequent); the size is 0 if there are none.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.withColumn("v", F.col("v").cast("array<double>")).filter(F.col("v").isNotNull())
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v"]
    table = materialize(rows.mapInArrow(_floors(scale, total), ", ".join([*others, "size int", "v binary"])), name)
    top = table.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = top["size"] if top else 0
    return table.filter(F.col("size") == size).drop("size"), size
