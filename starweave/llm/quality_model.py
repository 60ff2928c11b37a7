"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

1. One pass over the texts turns every document into a short vector of statistics (see STATISTICS); neither its id nor
   its language or source is among them. The vectors are written to the shared folder.
2. Labelled training vectors give means and deviations. A fixed random projection and a cosine map a standardised vector
   to ``features`` numbers whose inner products approximate a Gaussian kernel.
3. Each partition sums the normal equations of its rows, by row of the matrix; Spark adds the partitions' sums up. The
   driver receives one matrix of ``features`` + 1 rows, whatever the input, and solves it.
4. Two halves of the training rows are also solved apart, and each scores the other: these out-of-fold scores are
   counted on a fixed grid of ``bins`` and pooled to a rising step function (pool adjacent violators), which maps a raw
   score to the share of good documents.

Cases: null or empty text has the statistics of no words and gets a score like any other; rows without a label,
or whose label is null, do not train; a document with several labels trains once for each; repeated rows get
equal scores; a null id is never labelled and not held out; with no labelled rows, all scores are 0.5; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import materialize, ship

STATISTICS = ("log_words", "mean_length", "deviation_length", "upper", "digit", "symbol", "punctuation", "space", "beyond_ascii",
              "distinct", "most_common", "repeated_grams", "log_lines", "repeated_lines", "words_per_line", "upper_words",
              "marked_words", "short_lines")

# Classes of bytes.
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "punctuation": b"!\"'()+,-./:;=?@[\\]^_`{}~",
            "space": b" \t\n\x0b\x0c\r", "beyond_ascii": range(128, 256)}


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    bins: int = 2000
    seed: int = 20240502


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS for one text."""
    ws = text.split()
    n, size = len(ws), len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = {k: float(counts[list(v)].sum()) / max(size, 1) for k, v in _CLASSES.items()}
    lengths = np.fromiter(map(len, ws), dtype=np.float64, count=n)
    often = Counter(ws)
    grams = n - 2
    repeated = 1 - len(set(zip(ws, ws[1:], ws[2:]))) / grams if grams > 0 else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    per_line = n / len(lines) if lines else 0.0
    return [
        math.log1p(n), float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0,
        share["upper"], share["digit"], share["symbol"], share["punctuation"], share["space"], share["beyond_ascii"],
        math.log1p(len(often)) / math.log1p(n) if n else 0.0, max(often.values()) / n if n else 0.0, repeated,
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(per_line),
        sum(map(bytes.isupper, often)) / max(len(often), 1),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in often) / max(len(often), 1),
        sum(len(x) < 40 for x in lines) / len(lines) if lines else 0.0]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [statistics(t.as_py() or b"") for t in part.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every document."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(_vectors, f"id {dict(narrow.dtypes)['id']}, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class FourierMap:
    """Standardises vectors and maps them to random cosines, with a constant 1 in front."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0.0, 1.0 / s.width, (len(mean), s.features))
        self.b = rng.uniform(0.0, 2 * math.pi, s.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # far outliers are held at 10 deviations: beyond, the cosines would only wrap around
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return np.hstack([np.ones((len(x), 1)), math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def _x(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _normal_rows(mapping: FourierMap):
    """Partition sums of Z'Z and Z'y: one row for each fold and matrix row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            z, y = mapping(_x(batch)), batch.column("y").to_numpy()
            for f in np.unique(fold).tolist():
                at = fold == f
                total = z[at].T @ np.column_stack([z[at], y[at]])
                sums[f] = sums[f] + total if f in sums else total
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()),
                                              pa.array(m.tolist(), pa.list_(pa.float64()))], names=["fold", "i", "row"])

    return rows


def _add_rows(table: pa.Table) -> pa.Table:
    """Sum of one matrix row over the partitions (a group has one row per partition)."""
    total = np.array(table["row"].to_pylist()).sum(axis=0)
    return pa.table({"fold": table["fold"][:1], "i": table["i"][:1], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _solve(m: np.ndarray, ridge: float) -> np.ndarray:
    a, b = m[:, :-1].copy(), m[:, -1]
    rows = max(a[0, 0], 1.0)
    a[np.diag_indices(len(a))] += ridge * rows * np.r_[1e-9, np.ones(len(a) - 1)]
    return np.linalg.solve(a, b)


def _scores(mapping: FourierMap, weights: dict[int, np.ndarray], keep: tuple[str, ...], levels=None):
    """Raw scores under the weights of a row's ``fold`` (or of key 0), mapped through ``levels`` if given."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = mapping(_x(batch))
            if "fold" in batch.schema.names:
                w = np.stack([weights[f] for f in batch.column("fold").to_pylist()]) if batch.num_rows else np.zeros_like(z)
                raw = (z * w).sum(axis=1)
            else:
                raw = z @ weights[0]
            if levels is not None:
                raw = np.interp(raw, *levels)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.float64())],
                                             names=[*keep, "score"])

    return rows


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function closest to the means total / count at rising positions: (positions, levels)."""
    blocks: list[list[float]] = []  # first position, last position, sum, count
    for p, t, c in zip(at, total, count):
        blocks.append([p, p, t, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, t2, c2 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + t2, blocks[-1][3] + c2]
    xs = [x for b in blocks for x in b[:2]]
    ys = [b[2] / b[3] for b in blocks for _ in range(2)]
    return np.array(xs), np.clip(np.array(ys), 0.0, 1.0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          settings: Settings = Settings()) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    s = settings
    stats = materialize(vectors(docs, id_col, text_col), "statistics")
    base = F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out")
    marks = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter(
        F.col("y").isNotNull() & ~held_out(F.col("l_id")))
    train = stats.join(marks, F.col("id") == F.col("l_id")).select(
        "x", "y", (F.xxhash64("id") % 2 == 0).cast("int").alias("fold"))
    train = materialize(train, "training")
    d = len(STATISTICS)
    moments = train.agg(F.count(F.lit(1)), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return stats.select(*base, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mapping = FourierMap(np.array(moments[1::2]), np.array(moments[2::2]), s)

    sums = train.mapInArrow(_normal_rows(mapping), "fold int, i int, row array<double>")
    sums = sums.groupBy("fold", "i").applyInArrow(_add_rows, "fold int, i int, row array<double>").collect()
    m = np.zeros((2, s.features + 1, s.features + 2))
    for r in sums:
        m[r["fold"], r["i"]] = r["row"]
    whole = _solve(m.sum(axis=0), s.ridge)
    other = {f: _solve(m[1 - f], s.ridge) if m[1 - f].any() else whole for f in (0, 1)}
    fitted = train.mapInArrow(_scores(mapping, other, ("y",)), "y double, score double")
    cell = F.floor((F.greatest(F.least("score", F.lit(1.5)), F.lit(-0.5)) + 0.5) / 2 * s.bins)
    grid = fitted.groupBy(cell.alias("cell")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    at = np.array([(r["cell"] + 0.5) / s.bins * 2 - 0.5 for r in grid])
    levels = isotonic(at, np.array([r["y"] for r in grid]), np.array([r["n"] for r in grid]))
    scored = stats.mapInArrow(_scores(mapping, {0: whole}, ("id",), levels), f"id {dict(stats.dtypes)['id']}, score double")
    return scored.select(*base, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
