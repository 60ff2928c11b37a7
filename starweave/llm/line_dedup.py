"""Line dedup: a sharded minimal perfect hash indexes fingerprints, counts and keepers of the lines that repeat.

1. Every document gives the hash (64 bits) and fingerprint (64 further bits) of each distinct long line; only these,
   not the lines, are written to the shared folder.
2. Their documents are counted (pre-aggregated in each task), with the largest document id per line. The lines that
   reach ``min_docs`` are dealt to shards by their hash.
3. Each shard builds a minimal perfect hash (levels of bit arrays; a key sits in the first level in which no other key
   shares its cell, its number is the rank of its bit) and fills arrays of fingerprint, count and largest id.
4. Documents probe the arrays: line hashes, dealt by shard and salt, stream past the shard's arrays, which come first in
   the same partition. A shard holds at most about ``SHARD_KEYS`` keys, and its arrays are repeated for each salt, so a
   line that a third of all documents hold spreads over many tasks.
5. The lines to drop, collected per document, meet the documents again by id; only documents that lose lines are split.

Cases: null or empty text is one empty line and stays; ids are integers; rows with a null id count as documents but are
never the one that keeps a line (if all holders have null ids all keep it); repeated rows and ids count row by row, and
every row with the largest id keeps its lines; extra columns pass through, also if they are called like the added ones
(those then get a leading underscore); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import BROADCAST_LIMIT, WHITE_SPACE, ascii_lower, fresh_names, materialize, ship

SHARD_KEYS = 50_000
LEVELS = 40
LINE_SEED, PRINT_SEED = 42, 7  # of xxHash64; the first is also the seed of Spark's xxhash64
_STRIP = WHITE_SPACE.encode()


def _line_rows(min_chars: int):
    import xxhash

    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def emit(ids: list, hashes: list, prints: list) -> pa.RecordBatch:
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signed(hashes), signed(prints)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, prints = [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                seen = set()
                for line in (value.as_py() or b"").lower().split(b"\n"):
                    key = line.strip(_STRIP)
                    if len(key) >= min_chars and key not in seen and (key.isascii() or len(key.decode()) >= min_chars):
                        seen.add(key)
                        ids.append(doc)
                        hashes.append(xxhash.xxh64_intdigest(key, LINE_SEED))
                        prints.append(xxhash.xxh64_intdigest(key, PRINT_SEED))
                if len(ids) >= 50_000:
                    yield emit(ids, hashes, prints)
                    ids, hashes, prints = [], [], []
            yield emit(ids, hashes, prints)

    return rows


def line_hash(line: Column) -> Column:
    """The hash of a line's key as ``_line_rows`` computes it."""
    return F.xxhash64(ascii_lower(F.btrim(line, F.lit(WHITE_SPACE))))


def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    """Cell of each key (uint64) at a level: a mixed hash modulo the number of cells."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(cells)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys. ``number`` gives members 0..n-1 and others any number or -1."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, total = [], 0
        for cells, bits in levels:
            flat = np.unpackbits(bits, count=cells)
            self.ranks.append((flat, np.cumsum(flat, dtype=np.int64) - flat + total))
            total += int(flat.sum())
        self.placed = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not len(keys):
                break
            cells = 2 * len(keys) + 1
            at = _cell(keys, level, cells)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append((cells, np.packbits(alone)))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, ((cells, _), (flat, rank)) in enumerate(zip(self.levels, self.ranks)):
            at = _cell(keys[todo], level, cells)
            found = flat[at] == 1
            out[todo[found]] = rank[at[found]]
            todo = todo[~found]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            found = self.rest[at] == keys[todo]
            out[todo[found]] = self.placed + at[found]
        return out


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """One row: a shard's perfect hash and its arrays in the order of the hash's numbers."""
    keys = table["h"].to_numpy().view(np.uint64)
    hashing = PerfectHash.build(keys)
    order = np.empty(len(keys), dtype=np.int64)
    order[hashing.number(keys)] = np.arange(len(keys))
    array = lambda name: np.ascontiguousarray(table[name].to_numpy()[order]).tobytes()
    keeper = table["keeper"].fill_null(-1).to_numpy()[order]
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()),
        "cells": pa.array([[c for c, _ in hashing.levels]], pa.list_(pa.int64())),
        "bits": pa.array([[b.tobytes() for _, b in hashing.levels]], pa.list_(pa.binary())),
        "rest": pa.array([hashing.rest.tobytes()], pa.binary()),
        "prints": pa.array([array("fp")], pa.binary()),
        "counts": pa.array([array("n")], pa.binary()),
        "keepers": pa.array([np.ascontiguousarray(keeper).tobytes()], pa.binary()),
        "has_keeper": pa.array([table["keeper"].is_valid().to_numpy()[order].tobytes()], pa.binary()),
    })


_SHARD = ("shard long, cells array<long>, bits array<binary>, rest binary, prints binary, counts binary, keepers binary, "
          "has_keeper binary")


def _probe(min_docs: int):
    """Streams rows sorted by shard, each shard's arrays first; yields (id, h) of the lines that a document loses."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64())])

    def load(row: dict) -> tuple:
        levels = [(c, np.frombuffer(b, dtype=np.uint8)) for c, b in zip(row["cells"], row["bits"])]
        return (PerfectHash(levels, np.frombuffer(row["rest"], dtype=np.uint64)),
                *(np.frombuffer(row[k], dtype=np.int64) for k in ("prints", "counts", "keepers")),
                np.frombuffer(row["has_keeper"], dtype=bool))

    def lost(index: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        hashing, prints, counts, keepers, has_keeper = index
        h, fp = part.column("h").to_numpy(), part.column("fp").to_numpy()
        number = hashing.number(h.view(np.uint64))
        at = np.maximum(number, 0)
        ids = part.column("id")
        mine = np.asarray(ids.fill_null(0).to_numpy())
        keeps = np.asarray(ids.is_valid()) & (mine == keepers[at])
        drop = (number >= 0) & (prints[at] == fp) & (counts[at] >= min_docs) & has_keeper[at] & ~keeps
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(drop)), pa.array(h[drop])], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shard = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            arrays = np.asarray(batch.column("cells").is_valid())
            starts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | arrays[1:] | arrays[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(shards)]):
                if arrays[a]:
                    index, shard = load({c: batch.column(c)[a].as_py() for c in batch.schema.names}), shards[a]
                elif shard == shards[a]:
                    yield lost(index, batch.slice(a, b - a))

    return stream


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, drop): per document id the hashes of the lines that it loses."""
    spark = docs.sparkSession
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = materialize(narrow.mapInArrow(_line_rows(min_chars), "id long, h long, fp long"), "line-hashes")
    counts = lines.groupBy("h", "fp").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    # two lines whose 64-bit hashes agree keep their own fingerprints; the perfect hash needs distinct hashes, so of such
    # a pair the smaller fingerprint is indexed and the other line is kept everywhere
    frequent = counts.filter(F.col("n") >= min_docs).groupBy("h").agg(
        F.min_by(F.struct("fp", "n", "keeper"), "fp").alias("v")).select("h", "v.*")
    frequent = materialize(frequent, "frequent-lines")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    salts = max(4, -(-tasks // shards))
    shard = F.pmod(F.shiftrightunsigned("h", 20), F.lit(shards)).cast("long")
    index = materialize(frequent.withColumn("shard", shard).groupBy("shard").applyInArrow(_build_shard, _SHARD), "line-index")
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("first", F.lit(0))
    probes = lines.select("*", shard.alias("shard"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
                          F.lit(1).alias("first"))
    dealt = (arrays.unionByName(probes, allowMissingColumns=True)
             .repartition(max(tasks, shards), "shard", "salt").sortWithinPartitions("shard", "salt", "first"))
    hits = dealt.mapInArrow(_probe(min_docs), "id long, h long")
    return hits.groupBy("id").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
                broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with the repeated lines taken out of its text, plus n_lines (before) and n_dropped (longs).

    A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` documents hold stay only in the document with the largest id.
    """
    drops = materialize(repeated_lines(docs, id_col, text_col, min_chars, min_docs), "line-drops")
    size = drops.agg(F.sum(F.size("drop") * 8 + 32)).first()[0] or 0
    drop_id, drop, kept, n_lines, n_dropped = fresh_names(docs.columns, "drop_id", "drop", "kept", "n_lines", "n_dropped")
    drops = drops.select(F.col("id").alias(drop_id), F.col("drop").alias(drop))
    if size <= broadcast_limit:
        drops = F.broadcast(drops)
    c = lambda name: F.col(f"`{name}`")
    text = F.coalesce(c(text_col), F.lit(""))
    rest = F.filter(F.split(text, "\n", -1), lambda x: (F.char_length(F.btrim(x, F.lit(WHITE_SPACE))) < min_chars)
                    | ~F.array_contains(F.col(drop), line_hash(x)))
    joined = docs.join(drops, c(id_col).cast("long").eqNullSafe(F.col(drop_id)), "left")
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), rest))
    before = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    hit = F.col(kept).isNotNull()
    return joined.select(
        *[F.when(hit, F.array_join(kept, "\n")).otherwise(c(n)).alias(n) if n == text_col else c(n) for n in docs.columns],
        before.alias(n_lines), F.when(hit, before - F.size(kept)).otherwise(0).cast("long").alias(n_dropped))
