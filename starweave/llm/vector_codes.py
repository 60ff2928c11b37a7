"""Vector code compression: product quantisation whose nearest-entry search remembers what each grid cell can be nearest to.

Vectors are cut into ``parts`` equal consecutive parts. Each part position has a codebook of ``entries`` entries, which
begins as that part of the vectors with the smallest ids, is moved ``rounds`` times to the means of the parts nearest to
each entry (whole numbers, floors), and then codes every part by its nearest entry's index.

1. Vectors become whole numbers once, in a table that every round reads.
2. A part's coarse cell is the part divided by a power of two. For a cell not seen before, the least and the largest
   distance of every entry to the cell's box are computed: an entry whose least distance exceeds another's largest is
   nearest nowhere in the box. The entries left are remembered under the cell, and only they are evaluated exactly for
   its parts. The cache has at most ``cells`` cells a position and is emptied when full, which changes no result.
3. A round sums the parts by position and entry within each task; Spark adds the sums up, and the new codebooks (parts x
   entries x part length numbers, whatever the table's size) go out with the next round.
4. Errors by label are added up with partial sums and joined back; labels with a thousandth of all rows or more (a
   thousand at most) are joined by broadcast, the others by broadcast while small and else by a shuffle.

The cell's side is the largest power of two with a diagonal of at most ``diagonal`` times the median distance of entries to
their nearest neighbours, so it follows the codebook as it moves.

Cases: see ``grid_vectors.whole_vectors`` for vectors that are left out; lengths that do not divide are filled with zeros at
the end; ties go to the lower index; equal ids are ordered by their vectors, null ids come last; fewer vectors than
``entries`` give smaller codebooks; repeated rows are coded each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starweave.llm.common import BROADCAST_LIMIT, materialize
from starweave.llm.grid_vectors import unpacked, whole_vectors


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    diagonal: float = 1.0
    cells: int = 16_384
    block: int = 4096


class CellCache:
    """Nearest entries of one position's codebook, searched among those that a part's cell leaves."""

    def __init__(self, codebook: np.ndarray, s: Settings):
        self.codebook, self.most = codebook, s.cells
        apart = ((codebook[:, None, :] - codebook[None, :, :]).astype(float) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.inf)
        nearest = np.sqrt(np.median(apart.min(axis=1))) if len(codebook) > 1 else 1.0
        side = s.diagonal * nearest / max(codebook.shape[1], 1) ** 0.5
        self.shift = max(int(np.log2(max(side, 1.0))), 0)
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = self.missed = 0

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """For every cell, which entries are nearest to some point of its box (a superset)."""
        low = (cells.astype(np.int64) << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        entries = self.codebook[None, :, :]
        least = (np.maximum(np.maximum(low - entries, entries - high), 0) ** 2).sum(axis=2)
        largest = (np.maximum(np.abs(entries - low), np.abs(high - entries)) ** 2).sum(axis=2)
        return least <= largest.min(axis=1)[:, None]

    def _candidates(self, parts: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray((parts >> self.shift).astype(np.int32))
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        new = [i for i, k in enumerate(names) if k not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(range(len(names)))
        self.missed += len(new)
        self.known.update(zip([names[i] for i in new], self._undominated(cells[first[new]])))
        return np.stack([self.known[k] for k in names])[place.ravel()]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each part, the lower index of equally near ones."""
        candidates = self._candidates(parts)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        for j, entry in enumerate(self.codebook):
            rows = np.flatnonzero(candidates[:, j])
            distance = ((parts[rows] - entry) ** 2).sum(axis=1)
            self.evaluated += len(rows)
            nearer = distance < best[rows]
            best[rows[nearer]], index[rows[nearer]] = distance[nearer], j
        return index, best


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Rows of numbers as (row, part, place within the part), filled with zeros to equal parts."""
    n, size = vectors.shape
    out = np.zeros((n, size + -size % parts), np.int64)
    out[:, :size] = vectors
    return out.reshape(n, parts, -1)


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, s.block):
            rows = batch.slice(at, s.block)
            yield rows, cut(unpacked(rows.column("v"), "<i4"), s.parts)


def _sums(codebooks: np.ndarray, s: Settings):
    """Counts and sums of a task's parts by position and nearest entry."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [CellCache(c, s) for c in codebooks]
        counts, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for _, vectors in _blocks(batches, s):
            for p, cache in enumerate(caches):
                index, _ = cache.nearest(vectors[:, p])
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                for j in np.unique(index):
                    sums[p, j] += vectors[index == j, p].sum(axis=0)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
                 pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return rows


def _codes(codebooks: np.ndarray, s: Settings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [CellCache(c, s) for c in codebooks]
        digits = len(f"{max(s.entries - 1, 255):x}")
        for batch, vectors in _blocks(batches, s):
            found = [cache.nearest(vectors[:, p]) for p, cache in enumerate(caches)]
            names = [f"{i:0{digits}x}" for i in range(s.entries)]
            codes = ["".join([names[i] for i in row]) for row in np.stack([i for i, _ in found], axis=1).tolist()]
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()),
                                              pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return rows


def train(table: DataFrame, size: int, s: Settings = Settings()) -> np.ndarray:
    """Codebooks (part, entry, place) of a table of whole vectors (columns id and v)."""
    first = table.orderBy(F.col("id").asc_nulls_last(), "v").limit(s.entries).select("v").collect()
    numbers = np.stack([np.frombuffer(r["v"], "<i4") for r in first])
    books = cut(numbers, s.parts).transpose(1, 0, 2).copy()
    width = books.shape[2]
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(s.rounds):
        found = table.select("v").mapInArrow(_sums(books, s), schema).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()
        for r in found:  # parts x entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``coded`` (written: id, label, code, error) with the error summed over the rows of its label."""
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    totals = totals.select(F.col("label").alias("t_label"), "label_error", "n")
    same = lambda t: F.col("label").eqNullSafe(F.col("t_label"))
    size = totals.agg(F.sum(F.coalesce(F.octet_length(F.col("t_label").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    if size <= limit:
        return coded.join(F.broadcast(totals), same(totals)).drop("t_label", "n")
    share = coded.count() // 1000
    hot = totals.filter(F.col("n") > share)
    marked = coded.join(F.broadcast(hot), same(hot), "left")
    rest = marked.filter(F.col("n").isNull()).select(*coded.columns)
    rest = rest.join(totals.filter(F.col("n") <= share), same(totals))
    return marked.filter(F.col("n").isNotNull()).drop("t_label", "n").unionByName(rest.drop("t_label", "n"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             settings: Settings = Settings(), limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per vector kept: id, label, code (two hex digits a part), error, label_error and codebooks_sha256."""
    s = settings
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    # a distance is a sum over one part of squares of differences, each up to twice a component
    table, size = whole_vectors(rows, s.scale, (1 << 60) * s.parts, "whole-vectors")
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    books = train(table, size, s) if size else np.zeros((s.parts, 0, 0), np.int64)
    coded = materialize(table.mapInArrow(_codes(books, s), schema), "codes")
    out = with_label_error(coded, limit)
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
                      F.lit(digest(books)).alias("codebooks_sha256"))
