"""Sequence packing: bounded-space online best-fit packing of token ids into fixed-length windows.

Each partition is read once, in order. A fixed number of windows is open at a time. A document's ids first fill whole
windows of their own; the rest goes to the open window with the least room that still holds it. When none does, the
fullest window is closed: a hole of ``min_cut`` ids or more is filled from the document at hand (documents may be cut
anywhere), a smaller hole stays padding. At the end of a partition its open windows are joined into full ones, so at
most one partly filled window per partition is left. These leftovers are merged the same way, ``fan_in`` partitions to
a task; the last window of a merge task is cut into sequences whose lengths are powers of two, which need no padding.

Memory per task: the open windows (``open_windows`` x ``length`` ids) and one batch of texts. Only rows about pieces are
kept, with a checksum of their ids; ids themselves travel only for the leftovers, one window per partition. The pieces
are written to the shared folder once, since both the finished and the leftover rows are read from them; a task that is
run again reads the same rows in the same order and numbers its sequences alike.

Cases: null text is an empty document (its end id alone is packed); repeated rows and ids are packed one by one; an
empty table gives no piece; very long texts are cut into as many windows as they need; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from starweave.llm.common import materialize, ship

WIDTH = 4  # bytes of an id: little-endian unsigned 32 bits
CACHE_ENTRIES = 200_000


@dataclass(frozen=True)
class Settings:
    """Parameters of packing; ``length`` must be a power of two."""

    length: int = 2048
    open_windows: int = 64
    min_cut: int = 16
    fan_in: int = 64
    end_id: int = 1


class _WordCache(dict):
    """Ids of a space and the word after it, as bytes; emptied when full so that its memory stays bounded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.encode(" " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def tokenizer(json_path: str | None, ranks_path: str, pattern: str, special: tuple[str, ...]) -> Callable[[str], bytes]:
    """Text to ids (as bytes) like the byte-level BPE of ``json_path`` with ``add_special_tokens=False`` (None if the
    vocabulary has ranks and no special tokens).

    The same vocabulary is read as ranks, which is faster. The splitting pattern starts a new piece at every space that
    follows a character other than white space, so a text in which no space follows white space is encoded word by word
    from a cache. A text that holds a special token's string goes through the JSON tokenizer itself.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain: list[Tokenizer] = []  # read when the first text with a special string comes
    pack = lambda ids: b"".join([i.to_bytes(WIDTH, "little") for i in ids])
    direct = lambda text: pack(bpe.encode_ordinary(text))
    by_word = _WordCache(direct).__getitem__
    double = re.compile(r"\s ")

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            if not plain:
                plain.append(Tokenizer.from_file(json_path))
            return pack(plain[0].encode(text, add_special_tokens=False).ids)
        if double.search(text):
            return direct(text)
        first, *rest = text.split(" ")
        return direct(first) + b"".join(map(by_word, rest))

    return encode


def public_tokenizer(name: str = "byte_bpe_50k", special: tuple[str, ...] = ("<|endoftext|>",)) -> Callable:
    """A maker of the public byte-level tokenizer ``name`` (its files' places are looked up where it is called)."""
    def make() -> Callable[[str], bytes]:
        import public_tokenizers

        return tokenizer(public_tokenizers.path(f"{name}.json") if special else None,
                         public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, special)

    return make


class _Packer:
    """Open windows of one task. A window is [used, pieces]; a piece is (id, start, ids, doc_tokens)."""

    def __init__(self, settings: Settings, first_sequence: int):
        self.s, self.next, self.open = settings, first_sequence, []

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Place ids (bytes) that begin at ``start`` of their document; yields the rows of windows that close."""
        full = self.s.length * WIDTH
        at = 0
        while len(ids) - at >= full:
            yield from self._close([self.s.length, [(doc, start + at // WIDTH, ids[at:at + full], total)]])
            at += full
        left = (len(ids) - at) // WIDTH
        while left:
            fits = [w for w in self.open if w[0] + left <= self.s.length]
            if fits:
                window, take = max(fits, key=lambda w: w[0]), left
            elif len(self.open) < self.s.open_windows:
                window, take = [0, []], left
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                take = self.s.length - window[0]
                if take < self.s.min_cut:
                    self.open.remove(window)
                    yield from self._close(window)
                    continue
            window[1].append((doc, start + at // WIDTH, ids[at:at + take * WIDTH], total))
            window[0] += take
            at, left = at + take * WIDTH, left - take
            if window[0] == self.s.length:
                self.open.remove(window)
                yield from self._close(window)

    def _close(self, window: list) -> Iterator[tuple]:
        number, self.next, offset = self.next, self.next + 1, 0
        for doc, start, ids, total in window[1]:
            yield doc, start, len(ids) // WIDTH, zlib.crc32(ids), total, number, offset, None
            offset += len(ids) // WIDTH

    def _joined(self) -> Iterator[tuple]:
        """Fill windows from the emptier ones until one at most is left open; yields the rows of the full ones."""
        rest, self.open = sorted(self.open, key=lambda w: -w[0]), []
        current: list = [0, []]
        for window in rest:
            for doc, start, ids, total in window[1]:
                while ids:
                    take = min(len(ids) // WIDTH, self.s.length - current[0])
                    current[1].append((doc, start, ids[:take * WIDTH], total))
                    current[0] += take
                    ids, start = ids[take * WIDTH:], start + take
                    if current[0] == self.s.length:
                        yield from self._close(current)
                        current = [0, []]
        if current[0]:
            self.open = [current]

    def leftover(self) -> Iterator[tuple]:
        """End of a partition: full windows, then the pieces of the last one with their ids and no sequence."""
        yield from self._joined()
        for window in self.open:
            for doc, start, ids, total in window[1]:
                yield doc, start, len(ids) // WIDTH, zlib.crc32(ids), total, None, None, ids

    def finish(self) -> Iterator[tuple]:
        """End of a merge task: full windows, then the last one as sequences of power-of-two lengths."""
        yield from self._joined()
        for used, pieces in self.open:
            size = 1 << (used.bit_length() - 1)
            part: list = [0, []]
            for doc, start, ids, total in pieces:
                while ids:
                    while used and size > used:
                        size >>= 1
                    take = min(len(ids) // WIDTH, size - part[0])
                    part[1].append((doc, start, ids[:take * WIDTH], total))
                    part[0] += take
                    ids, start = ids[take * WIDTH:], start + take
                    if part[0] == size:
                        yield from self._close(part)
                        used, part = used - size, [0, []]
        self.open = []


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
BATCH = 4096


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         make_tokenizer: Callable[[], Callable[[str], bytes]] = public_tokenizer(),
         settings: Settings = Settings()) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    s = settings
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = dict(narrow.dtypes)["id"]
    longs = ", ".join(f"{c} long" for c in COLUMNS)

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = make_tokenizer(), s.end_id.to_bytes(WIDTH, "little")
        task = TaskContext.get().partitionId()
        packer, schema = _Packer(s, task << 32), None

        def rows() -> Iterator[tuple]:
            for batch in batches:
                nonlocal schema
                schema = schema or _schema(batch.schema.field(0).type)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "") + end
                    yield from packer.add(doc, 0, ids, len(ids) // WIDTH)
            yield from packer.leftover()

        for row_batch in _lazy(rows(), lambda: schema):
            yield row_batch.append_column("task", pa.array([task] * row_batch.num_rows, pa.int64()))

    pieces = materialize(narrow.mapInArrow(by_partition, f"id {id_type}, {longs}, ids binary, task long"), "pieces")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        schema = _schema(table.schema.field("id").type)
        packer = _Packer(s, (1 << 62) + (key[0].as_py() << 32))
        # one leftover window per partition, so the group holds at most fan_in windows; a fixed order makes it repeatable
        table = table.sort_by([("task", "ascending"), ("at", "ascending")])

        def rows() -> Iterator[tuple]:
            for r in table.select(["id", "start", "ids", "doc_tokens"]).to_pylist():
                yield from packer.add(r["id"], r["start"], r["ids"], r["doc_tokens"])
            yield from packer.finish()

        return pa.Table.from_batches(list(_batches(rows(), schema)), schema=schema).drop_columns(["ids"])

    done = pieces.filter(F.col("sequence_id").isNotNull()).select("id", *COLUMNS)
    open_rows = pieces.filter(F.col("sequence_id").isNull()).select(
        "id", "start", "ids", "doc_tokens", "task", F.xxhash64("id", "start", "ids_crc32").alias("at"),
        (F.col("task") / s.fan_in).cast("long").alias("merge_task"))
    merged = open_rows.groupBy("merge_task").applyInArrow(merge, f"id {id_type}, {longs}")
    return done.unionByName(merged).withColumnRenamed("id", id_col)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("id", id_type), *[(c, pa.int64()) for c in COLUMNS], ("ids", pa.binary())])


def _lazy(rows: Iterator[tuple], schema: Callable[[], pa.Schema | None]) -> Iterator[pa.RecordBatch]:
    """``_batches`` whose schema is known only once the first row has been asked for."""
    first = next(rows, None)
    if first is None:
        return

    def again() -> Iterator[tuple]:
        yield first
        yield from rows

    yield from _batches(again(), schema())
