"""JSON documents that are one large array (or several objects), read by as many tasks as the files have splits.

The text source cuts a file at closing braces, which is as good a separator as a line break: a split reads the stretches that
begin in it. Whether a brace is structure or text, and how deep it stands, depends on what comes before:

1. ``_summaries``: each block by itself counts its undoubtedly unescaped quotes, and sums its structural brackets for either
   case (it begins inside a string, or outside).
2. The blocks of a file are put in order: the quotes before a block tell its case, the sums of the blocks before it its depth.
3. ``_cut``: each block again, from its state, gives the objects that end in it; those that cross blocks are put together from
   their pieces, as for CSV records (``framing.assembled``).

The objects become JSON lines below the shared folder, which Spark reads with its own reader and types.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starweave.session import scratch_path, ship, written
from starweave.sources.framing import HEAD, PIECES, TAIL, WHOLE, assembled, lines_of, pieces_of, runs, with_states

QUOTE, BACKSLASH = 34, 92
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
LIMIT = 32 << 20


class Structure:
    """Brackets of a stretch of JSON (that ends with a closing brace) which begins in a string or outside."""

    def __init__(self, data: np.ndarray):
        quotes = np.flatnonzero(data == QUOTE)
        before = data[quotes - 1] == BACKSLASH
        if len(quotes) and quotes[0] == 0:
            before[0] = False
        escaped = np.zeros(len(quotes), bool)
        for i in np.flatnonzero(before).tolist():
            first = at = int(quotes[i]) - 1
            while at >= 0 and data[at] == BACKSLASH:
                at -= 1
            escaped[i] = (first - at) % 2 == 1
        self.quotes = quotes[~escaped]
        self.brackets = np.flatnonzero(_STEP[data])
        self.steps = _STEP[data[self.brackets]].astype(np.int64)
        self.inside = np.searchsorted(self.quotes, self.brackets) & 1

    def outside(self, in_string: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, steps) of the structural brackets."""
        real = self.inside == in_string
        return self.brackets[real], self.steps[real]


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.format("text").option("lineSep", "}").load(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("block"),
                        F.concat(F.col("value").cast("binary"), F.lit("}").cast("binary")).alias("line"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None  # key, block, quotes, depth if it begins outside, depth if inside, root, wide
    done: list[list] = []
    for batch in batches:
        for key, block, first, end in runs(batch):
            if now is None or now[:2] != [key, block]:
                done += [now] if now else []
                now = [key, block, 0, 0, 0, None, False]
            data, _ = lines_of(batch.column("line").slice(first, end - first))
            found = Structure(data)
            odd = now[2] & 1
            for case in (0, 1):
                at, steps = found.outside(case ^ odd)
                now[3 + case] += int(steps.sum())
                if case == 0 and block == 0 and now[5] is None and len(at):
                    now[5], now[6] = chr(data[at[0]]), bool((data[:at[0] + 2] == 0).any())
            now[2] += len(found.quotes)
    done += [now] if now else []
    if done:
        columns = list(zip(*done))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["key", "block", "quotes", "outside", "inside", "root", "wide"])


_SUMMARY = "key long, block long, quotes long, outside long, inside long, root string, wide boolean"


def _states(blocks: DataFrame) -> DataFrame:
    """(key, block, in_string, depth, base, end) of every block; ``end`` is the depth after it."""
    order = Window.partitionBy("key").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cases = blocks.withColumn("in_string", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    cases = cases.withColumn("sum", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    root = F.first("root", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    depth = F.coalesce(F.sum("sum").over(before), F.lit(0))
    return cases.select("key", "block", "in_string", depth.alias("depth"), F.when(root == "[", 1).otherwise(0).alias("base"),
                        (depth + F.col("sum")).alias("end"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects and pieces of objects; line breaks between their parts become blanks."""
    now, in_string, depth, base, ordinal, kind, parts = None, 0, 0, 0, 0, WHOLE, []
    flat = lambda b: b.replace(b"\n", b" ").replace(b"\r", b" ")

    def rest() -> Iterator[pa.RecordBatch]:
        if parts:
            yield pieces_of(*now, ordinal, kind if kind == HEAD else TAIL, [b"".join(parts)])

    for batch in batches:
        states = [batch.column(c).to_numpy() for c in ("in_string", "depth", "base")]
        for key, block, first, end in runs(batch):
            if now != (key, block):
                yield from rest()
                now, ordinal, parts = (key, block), 0, []
                in_string, depth, base = (int(c[first]) for c in states)
                kind = HEAD if depth > base else WHOLE  # it begins within an object
            data, _ = lines_of(batch.column("line").slice(first, end - first))
            found = Structure(data)
            at, steps = found.outside(in_string)
            after = depth + np.cumsum(steps)
            starts, ends = at[(steps == 1) & (after == base + 1)], at[(steps == -1) & (after == base)]
            starts = starts[data[starts] == ord("{")] if len(starts) else starts
            text, whole = data.tobytes(), []
            if parts or kind == HEAD:  # an object is open
                if not len(ends):
                    parts.append(flat(text))
                else:
                    parts.append(flat(text[:ends[0] + 1]))
                    yield pieces_of(key, block, ordinal, kind, [b"".join(parts)])
                    ordinal += kind != HEAD
                    parts, kind, ends = [], WHOLE, ends[1:]
            for a, b in zip(starts.tolist(), ends.tolist()):
                whole.append(flat(text[a:b + 1]))
            if whole:
                yield pieces_of(key, block, ordinal, WHOLE, whole)
                ordinal += len(whole)
            if len(starts) > len(ends) and not parts:
                parts = [flat(text[starts[len(ends)]:])]
            in_string ^= len(found.quotes) & 1
            depth = int(after[-1]) if len(after) else depth
    if now:
        yield from rest()


def json_objects(spark: SparkSession, path: str, limit: int = LIMIT) -> str | None:
    """Write the objects of the documents below ``path`` as JSON lines and return their folder; None for other encodings
    than UTF-8. Elements that are no objects are left out; a document that does not end where it should is an error."""
    ship(spark)
    lines = _stretches(spark, path)
    blocks = written(lines.mapInArrow(_summaries, _SUMMARY), "json-blocks")
    if blocks.filter("wide").count():
        return None
    states = written(_states(blocks), "json-states")
    last = states.groupBy("key").agg(F.max_by("end", "block").alias("end"), F.max("base").alias("base"))
    if last.filter(~F.col("end").isin(0, -1)).count():  # a closing brace stands behind the last stretch
        raise ValueError("a JSON document is not complete")
    pieces = with_states(lines, states.drop("end"), limit).mapInArrow(_cut, PIECES)
    objects = assembled(written(pieces, "json-pieces")).select(F.col("record").cast("string").alias("value"))
    out = scratch_path(spark, f"starweave-{spark.sparkContext.applicationId}/json-lines-{uuid.uuid4().hex[:12]}")
    objects.write.text(out)
    return out
