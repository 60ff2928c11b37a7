"""WARC fixity audit: Merkle trees over record hashes and offset ranges, compared between replicas from the root down.

1. Every record of an archive file is hashed (SHA-256 of its bytes) where it lies; only (file, offset, length, digest)
   go on.
2. A leaf covers a fixed range of byte offsets of one file and hashes its records in offset order; an inner node hashes
   its ``fanout`` children in order, up to one root per file. Trees of different replicas have equal height, since it
   follows from the largest offset of all of them. Each level is a written table.
3. Roots of two replicas are compared; below a root or node that differs only its children are read and compared, and
   so on to the leaves. Only records of differing leaves are compared one by one.

A group never holds more than the records of ``leaf_bytes`` of one file, or twice ``fanout`` nodes; equal records at one offset
are counted, not repeated. Records without an offset have leaves of their own, ranges of digests of a 16-millionth each.

Cases: null file names are a file of their own; a null offset is reported as -1, and a record that has none is found missing
or extra (or changed, if only the number of its copies differs); a null payload is a record of no bytes; records may be repeated (their number is part of the hash); extra columns are ignored; an empty
replica differs from the other in every record, two empty ones in none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import materialize

LEAF_BYTES = 1 << 18
FANOUT_BITS = 4
DIGEST_LEAF_BITS = 24  # records without an offset: leaves are the digests that share so many leading bits


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a WARC response record with the given target and body."""
    length = F.octet_length(F.coalesce(body, F.lit(""))).cast("string")
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), length, F.lit("\r\n\r\n"), F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def with_digest(records: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``records`` with ``length`` and ``digest`` (SHA-256, hexadecimal) in place of the payload."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    return records.select(*[F.col(f"`{c}`") for c in records.columns if c not in (payload_col, "length", "digest")],
                          F.octet_length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("digest"))


def record_hashes(records: DataFrame, file_col: str = "file", offset_col: str = "offset",
                  payload_col: str | None = "payload") -> DataFrame:
    """(file, offset, length, digest, copies) of every record; written to the shared folder.

    With ``payload_col`` None the records have been through ``with_digest`` already.
    """
    hashed = records if payload_col is None else with_digest(records, payload_col)
    rows = hashed.select(F.col(f"`{file_col}`").cast("string").alias("file"),
                         F.coalesce(F.col(f"`{offset_col}`").cast("long"), F.lit(-1)).alias("offset"), "length", "digest")
    return materialize(rows.groupBy("file", "offset", "length", "digest").agg(F.count(F.lit(1)).alias("copies")), "record-hashes")


def _leaf() -> Column:
    """A record's leaf: its range of offsets, or without an offset (-1) a range of digests, numbered below zero."""
    by_digest = -1 - F.conv(F.substring("digest", 1, DIGEST_LEAF_BITS // 4), 16, 10).cast("long")
    return F.when(F.col("offset") < 0, by_digest).otherwise(F.floor(F.col("offset") / LEAF_BYTES).cast("long"))


def _up(level: int, levels: int) -> Column:
    """The parent of a node of ``level``; the roots join both kinds of leaves."""
    return F.lit(0).cast("long") if level == levels - 1 else F.shiftright("node", FANOUT_BITS)


def height(*replicas: DataFrame) -> int:
    """Levels above the leaves until every file has one node."""
    bounds = [r.agg(F.max(_leaf()), F.min("offset")).first() for r in replicas]
    bits = max((last or 0).bit_length() if (last or 0) > 0 else 0 for last, _ in bounds)
    if any(first is not None and first < 0 for _, first in bounds):
        bits = max(bits, DIGEST_LEAF_BITS)
    return max(1, -(-bits // FANOUT_BITS))


def tree(hashes: DataFrame, levels: int) -> list[DataFrame]:
    """Per level from the leaves (0) to the roots: (file, node, digest), each written to the shared folder."""
    def digest(parts: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(parts), lambda p: F.array_join(p["text"], ":")), "\n"), 256)

    text = F.array(F.col("offset").cast("string"), F.col("length").cast("string"), F.col("copies").cast("string"), F.col("digest"))
    level = hashes.groupBy("file", _leaf().alias("node")).agg(
        digest(F.collect_list(F.struct("offset", "digest", "length", text.alias("text")))).alias("digest"))
    out = [materialize(level, "merkle-0")]
    for k in range(1, levels + 1):
        text = F.array(F.col("node").cast("string"), F.col("digest"))
        level = out[-1].groupBy("file", _up(k - 1, levels).alias("up")).agg(
            digest(F.collect_list(F.struct("node", text.alias("text")))).alias("digest"))
        out.append(materialize(level.withColumnRenamed("up", "node"), f"merkle-{k}"))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) in which two levels differ, or that only one of them has."""
    x = a.select(F.col("file").alias("fa"), F.col("node").alias("na"), F.col("digest").alias("da"))
    y = b.select(F.col("file").alias("fb"), F.col("node").alias("nb"), F.col("digest").alias("db"))
    joined = x.join(y, F.col("fa").eqNullSafe(F.col("fb")) & (F.col("na") == F.col("nb")), "full_outer")
    return joined.filter(~F.col("da").eqNullSafe(F.col("db"))).select(
        F.when(F.col("na").isNotNull(), F.col("fa")).otherwise(F.col("fb")).alias("file"), F.coalesce("na", "nb").alias("node"))


def _below(level: DataFrame, node: Column, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
    return level.join(p, F.col("file").eqNullSafe(F.col("p_file")) & (node == F.col("p_node")), "left_semi")


def audit(hashes_a: DataFrame, hashes_b: DataFrame, levels: int | None = None, trees: tuple | None = None) -> DataFrame:
    """Damaged places: file, offset, kind (missing in b, extra in b, changed), digests on either side.

    Takes two results of ``record_hashes``; ``trees`` and ``levels`` may be given if they have been built before.
    """
    levels = height(hashes_a, hashes_b) if levels is None else levels
    a, b = trees or (tree(hashes_a, levels), tree(hashes_b, levels))
    bad = materialize(_differing(a[levels], b[levels]), "merkle-diff")
    for k in range(levels - 1, -1, -1):
        up = _up(k, levels)
        bad = materialize(_differing(_below(a[k], up, bad), _below(b[k], up, bad)), "merkle-diff")

    def places(hashes: DataFrame, side: str) -> DataFrame:
        found = _below(hashes.withColumn("leaf", _leaf()), F.col("leaf"), bad)
        kinds = F.sort_array(F.collect_list(F.array_join(F.array("digest", F.col("copies").cast("string")), "x")))
        return found.groupBy("file", "offset", "leaf").agg(F.array_join(kinds, ",").alias(f"digest_{side}")).select(
            F.col("file").alias(f"file_{side}"), F.col("offset").alias(f"offset_{side}"), F.col("leaf").alias(f"leaf_{side}"),
            f"digest_{side}")

    both = places(hashes_a, "a").join(places(hashes_b, "b"), F.col("file_a").eqNullSafe(F.col("file_b"))
                                      & (F.col("offset_a") == F.col("offset_b")) & (F.col("leaf_a") == F.col("leaf_b")), "full_outer")
    differ = both.filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return differ.select(F.when(F.col("offset_a").isNotNull(), F.col("file_a")).otherwise(F.col("file_b")).alias("file"),
                         F.coalesce("offset_a", "offset_b").alias("offset"), kind.alias("kind"), "digest_a", "digest_b")


def roots(*replicas: DataFrame) -> DataFrame:
    """(replica, file, root) of several results of ``record_hashes``, numbered from 0."""
    levels = height(*replicas)
    tops = [tree(r, levels)[-1].select(F.lit(i).alias("replica"), "file", F.col("digest").alias("root"))
            for i, r in enumerate(replicas)]
    return reduce(DataFrame.unionByName, tops)
