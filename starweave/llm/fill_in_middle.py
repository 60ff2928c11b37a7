"""Fill-in-middle: texts cut at two unit boundaries and put in prefix-suffix-middle or suffix-prefix-middle order.

A unit is a run of ASCII letters or any other single character. Nothing is split into units: the bytes of a block of
texts become a sequence of character classes, and a wavelet matrix over it answers how often a class occurs before a
position. Units begin at every class but two (continuation bytes, letters inside a run), so the units before a position
are the position less two ranks, and the characters before it are the position less one rank. The number of units of a
text is a difference of two such counts; a cut after so many units is found by bisection on them, for all texts of the
block at once.

Both cuts and the form come from SHA-256 of ``seed:id``, so a text is cut alike wherever and whenever it is read.

Memory per task: one Arrow batch, and the matrix of one block of ``block_bytes`` (a longer text is a block of its own; the
matrix takes about five bits a byte). There is no shuffle.

Cases: null text is an empty one; empty texts, texts with one of the three marks, and the share above ``plain_from`` stay
as they are (form ``plain``, lengths null); a null id is hashed as the empty text; repeated rows are cut alike, each for
itself; an empty table gives no row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import ship

# Character classes of bytes; units begin at every class from ``BEGINS`` on.
CONTINUATION, INSIDE, BEGINS, DIGIT, BLANK, BREAK, SIGN, WIDE = range(8)
LEVELS = 3


@dataclass(frozen=True)
class Settings:
    """``plain_from`` and ``spm_below`` are shares of 100; no end of a mark may be the beginning of one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20
    block_bytes: int = 4 << 20


def _class_table() -> np.ndarray:
    """Class of each byte; letters count as ``INSIDE`` until the first of a run is found."""
    out = np.full(256, SIGN, np.uint8)
    out[0x80:0xC0] = CONTINUATION
    out[0xC0:] = WIDE
    for first, last, kind in ((b"A", b"Z", INSIDE), (b"a", b"z", INSIDE), (b"0", b"9", DIGIT), (b"\n", b"\r", BREAK)):
        out[ord(first):ord(last) + 1] = kind
    out[[ord(" "), ord("\t")]] = BLANK
    return out


_CLASSES = _class_table()


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte of concatenated texts that begin at ``starts``."""
    out = _CLASSES[data]
    letter = out == INSIDE
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = starts[starts < len(data)]
    first[at] = letter[at]
    out[first] = BEGINS
    return out


class Bits:
    """A bit sequence in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Rank queries over a sequence of small numbers: a bit plane a level, highest bit first, zeros before ones."""

    def __init__(self, sequence: np.ndarray, levels: int = LEVELS):
        self.planes: list[tuple[int, Bits, int]] = []
        for level in reversed(range(levels)):
            bit = (sequence >> level & 1).astype(bool)
            zeros = sequence[~bit]
            self.planes.append((level, Bits(bit), len(zeros)))
            sequence = np.concatenate([zeros, sequence[bit]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each position."""
        start, end = np.zeros(1, np.int64), at
        for level, bits, zeros in self.planes:
            if value >> level & 1:
                start, end = zeros + bits.ones(start), zeros + bits.ones(end)
            else:
                start, end = start - bits.ones(start), end - bits.ones(end)
        return end - start

    def characters(self, at: np.ndarray) -> np.ndarray:
        return at - self.rank(CONTINUATION, at)

    def units(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each position."""
        return at - self.rank(CONTINUATION, at) - self.rank(INSIDE, at)

    def after_units(self, count: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the text from ``starts`` to ``ends`` is cut so that ``count`` of its units come before the cut.

        The cut is the last position before which no more than ``count`` units have begun: a unit that has begun goes on
        until the next one does.
        """
        wanted = self.units(starts) + count
        low, high = starts.copy(), ends.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            enough = self.units(mid) <= wanted
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        return low


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` bytes together (or one longer text)."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cut(s: Settings):
    marks = [m.encode() for m in (s.prefix, s.suffix, s.middle)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column("text"))
            draws = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for first, last in _blocks(np.diff(offsets), s.block_bytes):
                at = offsets[first:last + 1] - offsets[first]
                block = data[offsets[first]:offsets[last]]
                starts, ends = at[:-1], at[1:]
                h1, h2, h3, h4 = (h[first:last] for h in draws)
                matrix = WaveletMatrix(classes(block, starts))
                n = matrix.units(ends) - matrix.units(starts)
                one, two = h1 % (n + 1), h2 % (n + 1)
                a = matrix.after_units(np.minimum(one, two), starts, ends)
                b = matrix.after_units(np.maximum(one, two), starts, ends)
                chars = matrix.characters(a) - matrix.characters(starts), matrix.characters(b) - matrix.characters(a)
                whole, forms, out = block.tobytes(), [], []
                spm = h4 % 100 < s.spm_below
                plain = (n == 0) | (h3 % 100 >= s.plain_from)
                for i in range(last - first):
                    text = whole[starts[i]:ends[i]]
                    if plain[i] or any(m in text for m in marks):
                        forms.append("plain")
                        out.append(text)
                        continue
                    p, m, t = whole[starts[i]:a[i]], whole[a[i]:b[i]], whole[b[i]:ends[i]]
                    forms.append("spm" if spm[i] else "psm")
                    out.append(b"".join([marks[1], t, marks[0], p, marks[2], m] if spm[i] else
                                        [marks[0], p, marks[1], t, marks[2], m]))
                kept = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[first:last], pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                     *(pa.array(c, pa.int64(), mask=kept) for c in chars), pa.array(out, pa.binary())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: id, units ``n``, form, characters of prefix and middle, and the text to train on."""
    ship(docs.sparkSession)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    rows = docs.select(key.alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"), digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = rows.select("id", "text", *draws)
    out = rows.mapInArrow(_cut(settings), f"id {dict(rows.dtypes)['id']}, n long, form string, prefix_chars long, "
                                          "middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The exact text from its output and form. The marks occur nowhere else in a text that was cut, so they split it."""
    marks = "|".join(re.escape(m) for m in (settings.prefix, settings.suffix, settings.middle))
    parts = F.split(output, marks, -1)
    order = F.when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
    return F.when(form == "plain", output).otherwise(
        order.otherwise(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))))
