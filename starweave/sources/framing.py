"""Records of delimited text whose quoted fields may hold line breaks, found without giving up the splits of a file.

Whether a line break ends a record depends on everything before it in the file: is a quoted field open? A quote opens a field
only at the field's start, and in an open field only an undoubled quote closes it. What a block (the lines that one input
split reads) does to that state is a function of two values, and such functions can be composed:

1. ``summarise``: every block, by itself, from both states: in which state does it end? The two courses usually become one at
   the first line without an open quote, and are computed together for all quotes of a batch where they alternate properly.
2. ``inside_blocks``: the blocks of each file, one row each, are composed in order; those that begin in an open field are kept.
3. ``frame``: every block again, now with its state, is cut at the line breaks that end records. Records within a block are
   ranges of its bytes. What a block begins or ends in the middle of (at most two pieces a block) is put together by a
   shuffle of these pieces alone.

Bytes go through Arrow, and the work on them is vectorised; memory is a batch of lines, and the record that is open.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from starweave.session import ship, written

# Delimiters tried in this order on the first line; the first one present wins.
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","
QUOTE, LF, CR = 34, 10, 13
UTF8_MARK, UTF16_MARKS = b"\xef\xbb\xbf", (b"\xff\xfe", b"\xfe\xff")
WHOLE, TAIL, HEAD = 0, 1, 2


class Course:
    """The quotes of some lines: whether a quoted field is open after each number of them, from either state."""

    def __init__(self, data: np.ndarray, seps: bytes):
        self.at = np.flatnonzero(data == QUOTE)
        self.before = np.where(self.at > 0, data[self.at - 1], LF)
        self.starts = np.isin(self.before, np.frombuffer(seps + b"\r\n", np.uint8))  # a field begins there
        self.doubled = np.zeros(len(self.at), bool)  # right after another quote
        self.doubled[1:] = np.diff(self.at) == 1

    def _alternating(self, state: int) -> np.ndarray | None:
        """Open or not after each quote if every quote that would open a field may do so."""
        open_after = (np.arange(len(self.at) + 1) + state) & 1
        opening = open_after[1:] == 1
        return open_after if (self.starts | self.doubled | ~opening).all() else None

    def _stepwise(self, state: int, other: np.ndarray | None) -> np.ndarray:
        """The same quote by quote, up to where the course meets ``other``."""
        n, out, k = len(self.at), np.empty(len(self.at) + 1, np.int64), 0
        out[0] = state
        while k < n:
            if other is not None and other[k] == state and not self.doubled[k]:
                out[k:] = other[k:]
                return out
            if state and k + 1 < n and self.doubled[k + 1]:
                out[k + 1:k + 3] = 1
                k += 2
                continue
            state = 0 if state else int(self.starts[k])
            k += 1
            out[k] = state
        return out

    def run(self, states: tuple[int, ...]) -> list[np.ndarray]:
        """The course from each of ``states`` (one or both)."""
        found = {s: self._alternating(s) for s in (0, 1)}
        out = []
        for s in states:
            course = found[s] if found[s] is not None else self._stepwise(s, found[1 - s])
            found[s] = course
            out.append(course)
        return out

    def open_at(self, course: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Open or not at each of the positions ``ends``."""
        return course[np.searchsorted(self.at, ends)]


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column of lines, each with its line break."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(key, block, first row, end row) of the rows of a batch that belong to the same block."""
    key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
    if len(key):
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            yield int(key[first]), int(block[first]), first, end


def detect_delimiter(line: bytes) -> str:
    return next((d for d in DELIMITERS if d.encode() in line), DEFAULT_DELIMITER)


def fields_of(record: bytes, delimiter: str) -> list[bytes]:
    """The fields of one record, as bytes."""
    csv.field_size_limit(1 << 30)
    rows = list(csv.reader([record.decode("latin-1")], delimiter=delimiter))
    return [f.encode("latin-1") for f in rows[0]] if rows else []


def column_names(fields: list[bytes], header: bool) -> list[bytes]:
    """Names of a file's columns: empty ones are numbered, repeated ones (in whatever case) get a number behind them."""
    if not header:
        return [f"_c{i}".encode() for i in range(len(fields))]
    out, taken = [], set()
    for i, name in enumerate(fields):
        name = name or f"Unnamed: {i}".encode()
        unique, n = name, 0
        while unique.lower() in taken:
            n += 1
            unique = name + f".{n}".encode()
        taken.add(unique.lower())
        out.append(unique)
    return out


class _Summary:
    """What the lines of one block tell about its file."""

    def __init__(self, key: int, block: int, sep: str | None, header: bool):
        self.key, self.block, self.sep, self.header = key, block, sep, header
        self.ends, self.open, self.utf8, self.wide, self.cr, self.mask = [0, 1], False, True, False, False, 0
        self.first = b"" if block == 0 else None  # the lines of the first record so far
        self.names: list[bytes] | None = None
        self.delimiter: str | None = None

    def add(self, data: np.ndarray, offsets: np.ndarray, utf8: bool) -> None:
        self.utf8 &= utf8
        if self.first is not None and self.names is None:
            self._header(data.tobytes(), offsets)
        course = Course(data, self.sep.encode()[-1:] if self.sep else "".join(DELIMITERS).encode())
        if len(course.at):
            for i, d in enumerate(DELIMITERS):
                self.mask |= int((course.before == ord(d)).any()) << i
            states = tuple(dict.fromkeys(self.ends))
            found = dict(zip(states, course.run(states)))
            breaks = offsets[1:] if not self.cr else np.flatnonzero(data == CR)
            self.open |= bool(course.open_at(found[self.ends[0]], breaks).any())
            self.ends = [int(found[s][-1]) for s in self.ends]
        else:
            self.open |= self.ends[0] == 1

    def _header(self, text: bytes, offsets: np.ndarray) -> None:
        """Take lines until the first record that is not blank is complete."""
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            line = text[start:end]
            if not self.first:
                self.wide = self.wide or line[:2] in UTF16_MARKS
                line = line.removeprefix(UTF8_MARK)
            self.first += line
            if not self.first.strip():
                self.first = b""
                continue
            self.delimiter = self.sep or detect_delimiter(self.first)
            bytes_ = np.frombuffer(self.first, np.uint8)
            course = Course(bytes_, self.delimiter.encode()[-1:])
            (opened,) = course.run((0,))
            breaks = np.flatnonzero(bytes_[:-2] == CR) if len(bytes_) > 2 else np.zeros(0, int)
            outside = breaks[course.open_at(opened, breaks) == 0]
            if len(outside) and self.first[:outside[0]].strip():  # lines end with a carriage return alone
                self.cr, self.first = True, self.first[:outside[0]]
            elif opened[-1]:
                continue
            self.names = column_names(fields_of(self.first.rstrip(b"\r\n"), self.delimiter), self.header)
            return

    def row(self) -> tuple:
        return (self.key, self.block, self.utf8, self.wide, self.cr, self.mask, self.ends[0], self.ends[1], self.open,
                self.delimiter, self.names)


_SUMMARY = ("key long, block long, utf8 boolean, wide boolean, cr boolean, mask int, end_out int, end_in int, open boolean, "
            "delimiter string, names array<binary>")
_SUMMARY_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("utf8", pa.bool_()), ("wide", pa.bool_()), ("cr", pa.bool_()),
                            ("mask", pa.int32()), ("end_out", pa.int32()), ("end_in", pa.int32()), ("open", pa.bool_()),
                            ("delimiter", pa.string()), ("names", pa.list_(pa.binary()))])


def _summaries(sep: str | None, header: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Summary | None = None
        done: list[tuple] = []
        for batch in batches:
            valid = batch.column("utf8").to_numpy(zero_copy_only=False)
            for key, block, first, end in runs(batch):
                if now is None or (now.key, now.block) != (key, block):
                    done += [now.row()] if now else []
                    now = _Summary(key, block, sep, header)
                now.add(*lines_of(batch.column("line").slice(first, end - first)), bool(valid[first:end].all()))
        done += [now.row()] if now else []
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY_ARROW.names, r)) for r in done], _SUMMARY_ARROW)

    return rows


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, block, line with its break as bytes): the key is a hash of the file's path, the block a split's first byte."""
    lines = spark.read.format("text").option("lineSep", "\n").load(paths)
    return lines.select(F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("block"),
                        F.concat(F.col("value").cast("binary"), F.lit("\n").cast("binary")).alias("line"))


def decoded_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """The same for files that cannot be cut at bytes (UTF-16, or lines that end with a carriage return): one task a file."""
    whole = spark.read.format("binaryFile").load(paths)
    text = F.decode("content", encoding)
    lines = whole.select(F.xxhash64("_metadata.file_path").alias("key"), F.explode(F.split(text, "\r\n|\n|\r")).alias("value"))
    return lines.select("key", F.lit(0).cast("long").alias("block"), F.concat("value", F.lit("\n")).cast("binary").alias("line"))


def summarise(lines: DataFrame, sep: str | None = None, header: bool = True) -> DataFrame:
    """One row per block: validity, marks, its effect on an open field, and in a file's first block the header's fields.

    ``open``: some line ends in an open field (from a closed start). ``mask``: which of ``DELIMITERS`` stand before a quote;
    without ``sep`` a quote after any of them may open a field.
    """
    ship(lines.sparkSession)
    marked = lines.select("key", "block", "line", F.is_valid_utf8(F.col("line").cast("string")).alias("utf8"))
    return marked.mapInArrow(_summaries(sep, header), _SUMMARY)


def inside_blocks(blocks: DataFrame) -> DataFrame:
    """(key, block) of the blocks that begin in an open field: the composition of the blocks before them in their file."""
    order = Window.partitionBy("key").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = (F.col("end_out") == 1) & (F.col("end_in") == 0)
    counted = blocks.select("key", "block", "end_out", "end_in", F.sum(flips.cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("flips"))
    fixed = F.last(F.when(F.col("end_out") == F.col("end_in"), F.struct("end_out", "flips")), True).over(before)
    since = F.coalesce(F.lag("flips").over(order), F.lit(0)) - F.coalesce(fixed["flips"], F.lit(0))
    state = (F.coalesce(fixed["end_out"], F.lit(0)) + since) % 2
    return counted.select("key", "block", state.alias("state")).filter("state = 1").select("key", "block")


class _Framer:
    """Records of one block; pieces are joined lines."""

    def __init__(self, key: int, block: int, inside: bool, seps: bytes):
        self.key, self.block, self.seps, self.state = key, block, seps, int(inside)
        self.open: list[bytes] = []  # lines of the record that is open
        self.kind = HEAD if inside else WHOLE
        self.ordinal = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, bytes | None]]:
        """Closed records of these lines as (kind, starts, ends) into ``data``, with what was open before the first."""
        course = Course(data, self.seps)
        (states,) = course.run((self.state,))
        closed = np.flatnonzero(course.open_at(states, offsets[1:]) == 0)
        self.state = int(states[-1])
        out = []
        if not len(closed):
            self.open.append(data.tobytes())
            return out
        starts, ends = np.concatenate([[0], offsets[closed[:-1] + 1]]), offsets[closed + 1]
        if self.open or self.kind == HEAD:
            out.append((self.kind, starts[:1], ends[:1], b"".join(self.open)))
            starts, ends, self.open, self.kind = starts[1:], ends[1:], [], WHOLE
        if len(starts):
            out.append((WHOLE, starts, ends, None))
        if offsets[closed[-1] + 1] < len(data):
            self.open = [data[offsets[closed[-1] + 1]:].tobytes()]
        return out

    def rest(self) -> tuple[int, bytes] | None:
        """The piece that is open at the block's end."""
        return ((HEAD if self.kind == HEAD else TAIL), b"".join(self.open)) if self.open else None


PIECES = "key long, block long, ordinal long, kind int, record binary"


def pieces_of(key: int, block: int, first: int, kind: int, records: list[bytes] | pa.Array) -> pa.RecordBatch:
    n = len(records)
    ordinal = np.arange(first, first + n)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, key), pa.int64()), pa.array(np.full(n, block), pa.int64()), pa.array(ordinal, pa.int64()),
         pa.array(np.full(n, kind), pa.int32()), records if isinstance(records, pa.Array) else pa.array(records, pa.binary())],
        names=["key", "block", "ordinal", "kind", "record"])


def _cut(seps: bytes):
    def closed(now: _Framer, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind, starts, ends, before in now.add(data, offsets):
            if before is not None:  # the record that was open; a head is no record of this block
                record = before + data[starts[0]:ends[0]].tobytes()
                if kind == HEAD or record.strip():
                    yield pieces_of(now.key, now.block, now.ordinal, kind, [record])
                    now.ordinal += kind != HEAD
                continue
            body = data[:ends[-1]]
            shown = np.add.reduceat(body > 32, starts, dtype=np.int64) > 0  # blank records are no records
            cuts = np.concatenate([starts, ends[-1:]]).astype(np.int64)
            records = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(
                np.ascontiguousarray(body))]).filter(pa.array(shown)).cast(pa.binary())
            yield pieces_of(now.key, now.block, now.ordinal, kind, records)
            now.ordinal += int(shown.sum())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Framer | None = None
        for batch in batches:
            inside = batch.column("inside").to_numpy(zero_copy_only=False)
            for key, block, first, end in runs(batch):
                if now is None or (now.key, now.block) != (key, block):
                    if now and (rest := now.rest()):
                        yield pieces_of(now.key, now.block, now.ordinal, rest[0], [rest[1]])
                    now = _Framer(key, block, bool(inside[first]), seps)
                    fresh = block == 0
                else:
                    fresh = False
                data, offsets = lines_of(batch.column("line").slice(first, end - first))
                if fresh and data[:3].tobytes() == UTF8_MARK:
                    data, offsets = data[3:], np.maximum(offsets - 3, 0)
                yield from closed(now, data, offsets)
        if now and (rest := now.rest()):
            yield pieces_of(now.key, now.block, now.ordinal, rest[0], [rest[1]])

    return rows


def with_states(lines: DataFrame, states: DataFrame, limit: int) -> DataFrame:
    """``lines`` with what ``states`` (written, one row a block) says of their blocks, each block's in their order."""
    of = states.select(F.col("key").alias("s_key"), F.col("block").alias("s_block"), *[c for c in states.columns if c not in ("key", "block")])
    same = (F.col("key") == F.col("s_key")) & (F.col("block") == F.col("s_block"))
    if states.count() * 64 <= limit:
        return lines.join(F.broadcast(of), same, "left").drop("s_key", "s_block")
    lines = lines.withColumn("n", F.monotonically_increasing_id()).join(of, same, "left")
    return lines.repartition("key", "block").sortWithinPartitions("key", "block", "n").drop("s_key", "s_block", "n")


def frame(lines: DataFrame, inside: DataFrame | None, sep: str, limit: int = 32 << 20) -> DataFrame:
    """(key, block, ordinal, record): every record of the files, where it begins, and its number within that block.

    ``inside`` (written) holds the few blocks that begin in an open field. It is joined by broadcast while it is below
    ``limit``, which leaves the lines in their order; beyond, the lines are dealt out by block and sorted again.
    """
    if inside is None:
        lines = lines.withColumn("inside", F.lit(False))
    else:
        lines = with_states(lines, inside.withColumn("begun", F.lit(True)), limit).select(
            "key", "block", "line", F.coalesce("begun", F.lit(False)).alias("inside"))
    ship(lines.sparkSession)
    pieces = lines.mapInArrow(_cut(sep.encode()[-1:]), PIECES)
    if inside is None:
        return pieces.select("key", "block", "ordinal", "record")
    return assembled(written(pieces, "csv-records"))  # read for the whole records and for the pieces


def assembled(pieces: DataFrame) -> DataFrame:
    """(key, block, ordinal, record) from whole records and pieces: a tail begins a record, the heads after it go on with it,
    block by block (the head of a block comes before its tail)."""
    whole = pieces.filter(F.col("kind") == WHOLE).select("key", "block", "ordinal", "record")
    order = Window.partitionBy("key").orderBy("block", F.desc("kind"))
    tail = F.col("kind") == TAIL
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn(
        "n", F.sum(tail.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = parts.groupBy("key", "n").agg(
        F.min("block").alias("block"), F.max(F.when(tail, F.col("ordinal"))).alias("ordinal"),
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("pieces"))
    text = F.aggregate(F.col("pieces.record"), F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    return whole.unionByName(joined.select("key", "block", "ordinal", text.alias("record")))
