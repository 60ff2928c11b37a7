"""Exact top-k by inner product with a pivot table: distances to many pivots bound every score from above.

With squared norms, score(q, x) = (|q|^2 + |x|^2 - |q - x|^2) / 2, and |q - x| is at least |d(q, p) - d(x, p)| for every pivot
p. The largest of these differences over the pivots is a lower bound of the distance, hence an upper bound of the score.

1. Vectors become whole numbers once. ``pivots`` far-apart rows are chosen greedily from ``sample`` rows (a bounded sample that
   only decides how much is eliminated, never what is found), and the distances of every row to all pivots are written
   beside it: the pivot table. Each file's rows are sorted by nearest pivot, so that neighbours stand together.
2. The queries are dealt into groups of about ``group_bytes`` by a hash, one after the other. A group goes to the executors as
   one broadcast of that size, and every task streams its part of the pivot table past it, in blocks of ``block`` rows.
3. A query starts with the k-th best of its exact scores with the pivots, which are rows themselves. A block whose best bound
   (from the block's least and largest distances to the pivots and its largest norm) is below the query's k-th score is
   skipped. In the others the rows are evaluated exactly in the order of their bounds, a step at a time, until the next
   bound is below the k-th score by then; equal bounds are still evaluated, since ties go to the smaller id.
4. Each task returns its best k for each query; a rank over the query's rows of all tasks keeps k of them.

Work is queries x rows where nothing can be eliminated (a query set against all rows, in blocks); memory is bounded by a
group, its k best rows and a block. Groups of equal vectors take no special place: no shuffle has a vector as its key.

Scores are exact: components are held below the size at which double sums lose digits, and bounds are widened by more than
their rounding error.

Cases: see ``grid_vectors.whole_vectors`` for vectors that take no part (neither as query nor as candidate); ids may repeat
(a query is a row: other rows with its id are candidates, and each of them that is a query has its own k rows); null ids are
candidates, last among ties; with fewer than k other rows all are returned; an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starweave.llm.common import materialize, new_scratch
from starweave.llm.grid_vectors import packed, unpacked, whole_vectors

LAST = np.iinfo(np.int64).max  # stands for a null id among ties


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: int = 64
    pivots: int = 32
    sample: int = 1024
    group_bytes: int = 16 << 20
    block: int = 2048
    chunk: int = 64
    step: int = 512


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Row numbers of far-apart vectors: each next one is the farthest from those chosen."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector (row) to every pivot (column)."""
    squares = (vectors ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _pivot_table(pivots: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = distances(unpacked(batch.column("v"), "<i4").astype(float), pivots)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(table.argmin(axis=1), pa.int32()),
                     packed(table.astype("<f8").ravel(), np.full(len(table), table.shape[1]))],
                    names=[*batch.schema.names, "nearest", "away"])

    return rows


class Group:
    """A group of queries with the best rows found for each."""

    def __init__(self, uid: np.ndarray, vectors: np.ndarray, away: np.ndarray, least: np.ndarray, k: int):
        self.uid, self.vectors, self.away, self.k = uid, vectors, away, k
        self.norms = (vectors ** 2).sum(axis=1)
        self.least = least.copy()  # the k-th best score so far, or less
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(uid)
        self.evaluated = 0

    def _slack(self, away: np.ndarray) -> float:
        """More than what rounding can take from a squared bound (distances are rounded roots of exact whole numbers)."""
        largest = max(float(self.away.max(initial=0.0)), float(away.max(initial=0.0)), 1.0)
        return 1e-9 * largest * largest

    def search(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, away: np.ndarray, chunk: int, step: int) -> None:
        """Take the rows of one block into account."""
        norms, slack = (vectors ** 2).sum(axis=1), self._slack(away)
        low, high, top = away.min(axis=0), away.max(axis=0), norms.max()
        outside = np.maximum(np.maximum(self.away - high, low - self.away), 0.0).max(axis=1)
        open_ = np.flatnonzero((self.norms + top - outside ** 2 + slack) / 2 >= self.least)
        for at in range(0, len(open_), chunk):
            queries = open_[at:at + chunk]
            bound = np.zeros((len(queries), len(uid)))
            for p in range(away.shape[1]):
                np.maximum(bound, np.abs(self.away[queries, p][:, None] - away[None, :, p]), out=bound)
            bound = (self.norms[queries][:, None] + norms[None, :] - bound ** 2 + slack) / 2
            for q, bounds in zip(queries.tolist(), bound):
                self._evaluate(q, bounds, uid, ids, vectors, step)

    def _evaluate(self, q: int, bounds: np.ndarray, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, step: int) -> None:
        left = np.flatnonzero(bounds >= self.least[q])
        left = left[np.argsort(-bounds[left])]
        for at in range(0, len(left), step):
            rows = left[at:at + step]
            if bounds[rows[0]] < self.least[q]:
                return
            scores = vectors[rows] @ self.vectors[q]
            self.evaluated += len(rows)
            good = (scores >= self.least[q]) & (uid[rows] != self.uid[q])
            if good.any():
                self._keep(q, scores[good], ids[rows[good]], uid[rows[good]])

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if self.best[q] is not None:
            scores, ids, uid = (np.concatenate(x) for x in zip(self.best[q], (scores, ids, uid)))
        order = np.lexsort((uid, ids, -scores))[:self.k]
        self.best[q] = scores[order], ids[order], uid[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])


def _search(group, pivots: np.ndarray, s: Settings):
    """``group``: a broadcast of (uid, id, vectors, least scores) of the queries."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, query_id, vectors, least = group.value
        found = Group(uid, vectors.astype(float), distances(vectors.astype(float), pivots), least, s.k)
        for batch in batches:
            for at in range(0, batch.num_rows, s.block):
                part = batch.slice(at, s.block)
                ids = part.column("id").fill_null(LAST).to_numpy()
                found.search(part.column("uid").to_numpy(), ids, unpacked(part.column("v"), "<i4").astype(float),
                             unpacked(part.column("away"), "<f8"), s.chunk, s.step)
        hits = [q for q, best in enumerate(found.best) if best is not None]
        for at in range(0, len(hits), s.block):
            some = hits[at:at + s.block]
            scores, ids, others = (np.concatenate([found.best[q][i] for q in some]) for i in range(3))
            owner = np.repeat(some, [len(found.best[q][0]) for q in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[owner], pa.int64()), pa.array(query_id[owner], pa.int64()), pa.array(others, pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(scores.astype(np.int64), pa.int64())],
                names=["q", "query_id", "uid", "vec_id", "score"])

    return rows


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """The k best rows of every query row: query_id, rank (from 1), the row's id and score.

    ``is_query`` is a condition on a column ``id``, the whole number in ``id_col``.
    """
    s, spark = settings, vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    # sums of products and squares of differences (up to four times a square) stay below 2^53
    table, size = whole_vectors(rows, s.scale, 1 << 50, "whole-vectors")
    table = materialize(table.withColumn("uid", F.monotonically_increasing_id()), "numbered-vectors")
    sample = table.orderBy(F.xxhash64("uid"), "uid").limit(s.sample).select("uid", "v").collect() if size else []
    fields = "query_id long, rank int, vec_id long, score long"
    queries = table.filter(is_query).select("uid", "id", "v")
    n_queries = queries.count() if sample else 0
    if not n_queries:
        return spark.createDataFrame([], fields).withColumnRenamed("vec_id", id_col)
    pool = np.stack([np.frombuffer(r["v"], "<i4") for r in sample]).astype(float)
    chosen = choose_pivots(pool, s.pivots)
    pivots, pivot_uid = pool[chosen], np.array([sample[i]["uid"] for i in chosen])
    table = materialize(table.mapInArrow(_pivot_table(pivots), "id long, v binary, uid long, nearest int, away binary")
                        .sortWithinPartitions("nearest"), "pivot-table")

    groups = max(-(-n_queries * (size + len(pivots) + 4 * s.k) * 8 // s.group_bytes), 1)
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    path = new_scratch(spark, "top-k")
    for g in range(groups):
        got = queries.filter(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g).toArrow()  # about ``group_bytes``
        if not got.num_rows:
            continue
        uid, query_id = got["uid"].to_numpy(), got["id"].fill_null(LAST).to_numpy()
        numbers = unpacked(got["v"].combine_chunks(), "<i4")
        known = numbers.astype(float) @ pivots.T
        known[uid[:, None] == pivot_uid[None, :]] = -np.inf
        least = np.sort(known, axis=1)[:, -s.k] if len(pivots) >= s.k else np.full(len(uid), -np.inf)
        sent = spark.sparkContext.broadcast((uid, query_id, numbers, least))
        hits = table.select("id", "uid", "v", "away").mapInArrow(_search(sent, pivots, s), "q long, query_id long, uid long, vec_id long, score long")
        best = hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= s.k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(fields).parquet(path).withColumnRenamed("vec_id", id_col)
