"""MinHash near-dedup with b-bit signatures: documents whose word-shingle sets have a high Jaccard similarity.

1. One pass over the texts gives per document the number of distinct shingles, a 128-bit hash of the whole set, band
   keys (hashes of ``band_rows`` full minima each) and a packed signature: the low ``BITS`` bits of every minimum.
2. Documents with equal sets form a class, represented by its smallest id; only representatives go on, so thousands of
   copies cost one row each.
3. Representatives that share a band key are candidates. Each is compared with its bucket's hub (smallest id) only, not
   with everyone: similarity is estimated by bit counts of the signatures' XOR, corrected for chance agreement of the
   kept bits, and pairs that may reach the threshold are confirmed on the full shingle sets.
4. Components of the confirmed links. Buckets that still hold several components are finished exactly: members outside
   the bucket's largest component meet all members of other components in blocks of at most about ``BLOCK`` rows, again
   by bit counts first and full sets second. A task yields one link per document and component, never all pairs.
5. Components again with the new links. All iterations write their tables to the shared folder.

The band layout misses a pair at the threshold of 0.75 with probability below 1e-5 (32 bands of 4 rows); the estimate's
margin is four standard deviations.

Cases: null or empty text (or without words) has an empty set, is linked with nothing and kept; a text with fewer words
than a shingle is one shingle of all its words; rows that repeat an id are one document with the least of their
texts, and each of the rows gets its result; ids are integers; rows with a null id form no links and are kept; ties need no
rule since ids are compared; extra columns pass through ``drop_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import materialize, ship, small

BITS = 4
BLOCK = 512
WORD_CACHE = 200_000
_FOLD = 0x1111111111111111


@dataclass(frozen=True)
class Settings:
    """``percent``: least similarity of linked documents, in percent of the union."""

    shingle: int = 5
    percent: int = 75
    hashes: int = 256
    bands: int = 32
    band_rows: int = 4
    margin: float = 4.0
    seed: int = 20240501

    @property
    def least_estimate(self) -> float:
        """Estimates below this are not confirmed: the threshold less ``margin`` standard deviations."""
        s, chance = self.percent / 100, 1 / 2 ** BITS
        p = s + (1 - s) * chance
        return s - self.margin * (p * (1 - p) / self.hashes) ** 0.5 / (1 - chance)


# -- shingle sets and signatures (inside tasks) ---------------------------------------------------

class _WordHash(dict):
    """64-bit hash of each word; emptied when full so that its memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, cache: _WordHash, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of ``text`` with A-Z lower-cased."""
    ws = text.lower().split()
    h = np.fromiter(map(cache.__getitem__, ws), dtype=np.uint64, count=len(ws))
    if not len(h):
        return h
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)])
    return np.unique(out)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at:at + 1024][None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


_SKETCH = "id long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"


def _sketch(s: Settings):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache = _WordHash()
        rng = np.random.default_rng(s.seed)
        a = rng.integers(0, 1 << 31, s.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32)
        per_word = 64 // BITS
        shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                shingles = shingle_set(value.as_py() or b"", cache, s.shingle)
                if not len(shingles) or doc is None:
                    out.append((doc, len(shingles), 0, 0, [], []))
                    continue
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist()
                m = _minima(shingles, a, b)
                low = (m & np.uint32(2 ** BITS - 1)).astype(np.uint64).reshape(-1, per_word)
                sig = (low << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)
                used = m[:s.bands * s.band_rows].reshape(s.bands, s.band_rows).astype(np.uint64)
                keys = np.arange(1, s.bands + 1, dtype=np.uint64)
                for r in range(s.band_rows):
                    keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + used[:, r])
                out.append((doc, len(shingles), s1, s2, sig.tolist(), keys.view(np.int64).tolist()))
                if len(out) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py() or b"", cache, size).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], schema=schema)

    return rows


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = _shared(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Rows (a, b, set of a, set of b) to the pairs that are similar."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                  for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows


# -- bit counts ------------------------------------------------------------------------------------

def similarity(sig_a: Column, sig_b: Column, hashes: int) -> Column:
    """Estimated Jaccard similarity of two packed signatures, corrected for chance agreement of BITS bits."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(_FOLD).cast("long")))

    unequal = F.aggregate(F.zip_with(sig_a, sig_b, differing), F.lit(0), lambda t, x: t + x)
    chance = 1 / 2 ** BITS
    return (1 - unequal / hashes - chance) / (1 - chance)


def _estimates(x: np.ndarray, y: np.ndarray, hashes: int) -> np.ndarray:
    """The same for all rows of two blocks of signatures (uint64), as a matrix."""
    unequal = np.zeros((len(x), len(y)), dtype=np.int32)
    for k in range(x.shape[1]):
        d = x[:, k][:, None] ^ y[:, k][None, :]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        unequal += np.bitwise_count(d & np.uint64(_FOLD))
    chance = 1 / 2 ** BITS
    return (1 - unequal / hashes - chance) / (1 - chance)


# -- components ------------------------------------------------------------------------------------

def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that links reach.

    Each round points every id at its smallest neighbour, follows the pointers to their ends, and contracts the links to
    those ends; the links that remain shrink at least by half a round. Tables go to the shared folder.
    """
    links = materialize(links.select("a", "b").filter("a <> b").distinct(), name)
    result = None
    while True:
        both = links.union(links.select("b", "a"))
        pointers = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")), name)
        while True:
            up = pointers.select(F.col("id").alias("root"), F.col("root").alias("upper"))
            jumped = materialize(pointers.join(up, "root", "left").select(
                "id", F.coalesce("upper", "root").alias("root"), (F.col("upper") < F.col("root")).alias("moved")), name)
            pointers = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        if result is None:
            result = pointers
        else:
            up = pointers.select(F.col("id").alias("root"), F.col("root").alias("upper"))
            result = materialize(result.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root")), name)
        pa_, pb = (pointers.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        links = materialize(links.join(pa_, "a").join(pb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
                            .filter("a <> b").distinct(), name)
        if links.isEmpty():
            return result.select("id", F.col("root").alias("component"))


# -- the rest of large buckets ---------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of equal values of ``column`` in a sorted stream, each as one table (runs are bounded by the caller)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(column).to_numpy()
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(starts[:-1], starts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().view(np.uint64).reshape(len(flat), -1)


def _block_pairs(s: Settings):
    """A task's x rows and y rows to the ids involved and the packed index pairs that may be similar."""
    schema = pa.schema([("task", pa.int64()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64())),
                        ("pairs", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            side = table["is_x"].to_numpy()
            if side.all() or not side.any():
                continue
            x, y = table.filter(pa.array(side)), table.filter(pa.array(~side))
            xi, yi = x["id"].to_numpy(), y["id"].to_numpy()
            xc, yc = x["component"].to_numpy(), y["component"].to_numpy()
            hub, band = table["hub"][0].as_py(), table["band"][0].as_py()
            # other components only; two members outside the largest component once; the hub has been compared already
            ok = (xc[:, None] != yc[None, :]) & (y["main"].to_numpy()[None, :] | (xi[:, None] < yi[None, :]))
            ok &= (xi != hub)[:, None] & (yi != hub)[None, :]
            if ok.any():
                ok &= _estimates(_matrix(x["sig"]), _matrix(y["sig"]), s.hashes) >= s.least_estimate
            if not ok.any():
                continue
            bx, by = _matrix(x["bands"]), _matrix(y["bands"])
            for k in range(band):  # pairs that an earlier band has already
                ok &= bx[:, k][:, None] != by[:, k][None, :]
            at = np.argwhere(ok)
            if len(at):
                ux, ix = np.unique(at[:, 0], return_inverse=True)
                uy, iy = np.unique(at[:, 1], return_inverse=True)
                packed = np.stack([ix, iy], axis=1).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([table["task"][0].as_py()], pa.int64()), pa.array([xi[ux].tolist()], pa.list_(pa.int64())),
                    pa.array([yi[uy].tolist()], pa.list_(pa.int64())), pa.array([packed], pa.binary())], schema=schema)

    return rows


def _block_confirm(percent: int):
    """A task's index pairs and sets to links: per x at most one for each component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            head = table.filter(pa.compute.is_valid(table["pairs"]))
            rest = table.filter(pa.compute.is_null(table["pairs"]))
            if not len(head) or not len(rest):
                continue
            xs, ys = head["xs"][0].as_py(), head["ys"][0].as_py()
            sets = {i: np.frombuffer(b, np.uint64) for i, b in zip(rest["id"].to_pylist(), rest["shingles"].to_pylist())}
            of = dict(zip(rest["id"].to_pylist(), rest["component"].to_pylist()))
            done, found = set(), []
            for i, j in np.frombuffer(head["pairs"][0].as_py(), np.uint16).reshape(-1, 2).tolist():
                x, y = xs[i], ys[j]
                if (x, of[y]) not in done and _similar(sets[x], sets[y], percent):
                    done.add((x, of[y]))
                    found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows


def _remaining_links(members: DataFrame, sketch: DataFrame, found: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links between different components of ``found`` inside the buckets of ``members`` (band, key, id, hub, n)."""
    labelled = materialize(members.filter("n > 2").join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id")), "labelled")
    mixed = (labelled.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("band", "key").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"),
                                         F.max(F.struct("c", "component")).alias("top"))
             .filter("parts > 1").select("band", "key", F.col("top.component").alias("main_component"),
                                         F.ceil(F.col("size") / BLOCK).cast("int").alias("y_blocks"),
                                         F.ceil((F.col("size") - F.col("top.c")) / BLOCK).cast("int").alias("x_blocks")))
    rows = labelled.join(mixed, ["band", "key"]).withColumn("main", F.col("component") == F.col("main_component"))
    spread = F.xxhash64(F.col("id"), F.lit("block"))
    x = (rows.filter(~F.col("main")).withColumn("i", F.pmod(spread, F.col("x_blocks")).cast("int"))
         .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1))).withColumn("is_x", F.lit(True)))
    y = (rows.withColumn("j", F.pmod(spread, F.col("y_blocks")).cast("int"))
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))).withColumn("is_x", F.lit(False)))
    task = F.xxhash64("band", "key", "i", "j").alias("task")
    pick = lambda d: d.select(task, "is_x", "id", "component", "main", "hub", "band")
    parts = pick(x).unionByName(pick(y)).join(sketch.select("id", "sig", "bands"), "id")
    blocks = parts.repartition("task").sortWithinPartitions("task").mapInArrow(
        _block_pairs(s), "task long, xs array<long>, ys array<long>, pairs binary")
    blocks = materialize(blocks, "block-pairs")
    needed = blocks.select("task", F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("id"))
    sets = _shingle_sets(docs, needed.select("id").distinct(), s)
    needed = needed.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(sets, "id")
    stream = blocks.unionByName(needed, allowMissingColumns=True).repartition("task").sortWithinPartitions("task")
    return stream.mapInArrow(_block_confirm(s.percent), "a long, b long")


# -- the operator ----------------------------------------------------------------------------------

def _shingle_sets(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, shingles) for the given distinct ids, from their texts; written to the shared folder."""
    ids = materialize(ids.select(F.col("id").alias("w")), "wanted")
    wanted = docs.join(small(ids, 16), F.col("id") == F.col("w"), "left_semi")
    return materialize(wanted.mapInArrow(_sets(s.shingle), "id long, shingles binary"), "shingle-sets")


def _repeated_ids(narrow: DataFrame) -> DataFrame:
    """(twice): the ids that stand on several rows; written to the shared folder."""
    counts = narrow.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return materialize(counts.filter("c > 1").select(F.col("id").alias("twice")), "repeated-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    settings: Settings = Settings()) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id it reaches) and kept (it is that id)."""
    s = settings
    ship(docs.sparkSession)
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    twice = _repeated_ids(every)
    repeats = not twice.isEmpty()
    narrow = every
    if repeats:
        again = F.col("id") == F.col("twice")
        least = every.join(small(twice, 16), again, "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        narrow = materialize(every.join(small(twice, 16), again, "left_anti").unionByName(least), "one-text-per-id")

    sketch = materialize(narrow.mapInArrow(_sketch(s), _SKETCH), "sketches")
    real = sketch.filter("n_shingles > 0 and id is not null")
    classes = materialize(real.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = materialize(real.join(classes.select("rep"), F.col("id") == F.col("rep"), "left_semi")
                       .select("id", "sig", "bands"), "representatives")

    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).filter("n > 1")
    members = materialize(rows.join(buckets, ["band", "key"]), "members")
    pairs = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    sig = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = pairs.join(sig("a"), "a").join(sig("b"), "b").filter(
        similarity(F.col("sig_a"), F.col("sig_b"), s.hashes) >= s.least_estimate).select("a", "b")
    pairs = materialize(pairs, "pairs")
    sets = _shingle_sets(narrow, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), s)
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    links = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(
        _confirm(s.percent), "a long, b long"), "links")
    found = components(links)
    more = materialize(_remaining_links(members, reps, found, narrow, s), "more-links")
    if not more.isEmpty():
        found = components(links.union(more))

    labels = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sketch.join(labels, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    if repeats:
        rows = every.filter("id is not null").select("id")
        out = out.filter("id is null").unionByName(rows.join(out, "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                      F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of its rows the one with the least text).

    Rows without words or without an id all stay.
    """
    verdict = near_duplicates(docs, id_col, text_col, settings)
    dropped = materialize(verdict.filter(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key, text = F.col("row")[id_col].cast("long"), F.col("row")[text_col]
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    out = rows.join(small(dropped, 16), key == F.col("gone"), "left_anti")
    twice = _repeated_ids(docs.select(F.col(f"`{id_col}`").cast("long").alias("id")))
    if twice.isEmpty():
        return out.select(*columns)
    worded = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    again = (key == F.col("twice")) & worded
    one = (out.join(small(twice, 16), again, "left_semi").select(key.alias("id"), "row", text.alias("text"))
           .groupBy("id").agg(F.min_by("row", "text").alias("row")).select("row"))
    return out.join(small(twice, 16), again, "left_anti").unionByName(one).select(*columns)
