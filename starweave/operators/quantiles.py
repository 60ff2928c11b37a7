"""Exact quantiles of columns given as distinct values with their row counts.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and a window over a group sorts it in
one task; both hold a whole column in one place. Here the wanted ranks are bracketed first: while a bracket holds
more than ``BRACKET_ROWS`` distinct values it is cut at sketched quantiles of them, the rows of each part are counted
exactly, and only the parts that hold a wanted rank go on. What is left is small enough to be ordered in one task.
A value that a third of all rows hold is one row here. Interpolation is linear: ``lo + (hi - lo) * frac`` at
position ``p * (n - 1)``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from starweave.functions.frames import local_frame
from starweave.session import written

BRACKET_ROWS = 1_000_000
PARTS = 32


def weighted_quantiles(freq: DataFrame, probs: tuple[float, ...]) -> dict:
    """``{group: {prob: value}}`` of (g, v, n): n rows of group g hold the distinct value v (no NULLs).

    Only figures per group and bracket reach the driver (groups are columns: metadata-sized); ``g`` may be a struct.
    """
    spark = freq.sparkSession
    sizes = freq.groupBy("g").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).collect()
    wanted: dict[int, set[int]] = {}  # bracket: ranks inside it
    offset: dict[int, int] = {}  # bracket: rows of its group before it
    group, size = {}, {}
    for i, r in enumerate(sizes):
        group[i], size[i], offset[i] = r["g"], r["distinct"], 0
        at = [p * (r["rows"] - 1) for p in probs]
        wanted[i] = {int(x) for p in at for x in (math.floor(p), math.ceil(p))}
    if not sizes:
        return {}
    ids = local_frame(spark, [(*_parts(r["g"]), i) for i, r in enumerate(sizes)], _key_schema(freq))
    on = F.lit(True)
    for k, c in enumerate(_key_columns(freq)):
        on = on & c.eqNullSafe(ids[f"k{k}"])
    rows = freq.join(F.broadcast(ids), on).select("b", "v", "n")  # one row per group
    owner = {i: i for i in group}
    while max(size.values()) > BRACKET_ROWS:
        big = [b for b in wanted if size[b] > BRACKET_ROWS]
        grid = [k / PARTS for k in range(1, PARTS)]
        cuts = rows.where(F.col("b").isin(big)).groupBy("b").agg(F.percentile_approx("v", grid, 10000).alias("cuts"))
        parted = rows.join(F.broadcast(cuts), "b", "left").select(
            "b", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.lit(0)).alias("part"), "v", "n")
        counts = parted.groupBy("b", "part").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).collect()
        by: dict[int, list] = {}
        for r in counts:
            by.setdefault(r["b"], []).append((r["part"], r["rows"], r["distinct"]))
        new_wanted, new_size, new_offset, new_owner, keep = {}, {}, {}, {}, []
        for b, parts in by.items():
            before = offset[b]
            for part, n, distinct in sorted(parts):
                inside = {x for x in wanted[b] if before <= x < before + n}
                if inside:
                    new = len(keep)
                    keep.append((b, part, new))
                    new_wanted[new], new_size[new], new_offset[new], new_owner[new] = inside, distinct, before, owner[b]
                before += n
        names = local_frame(spark, keep, "b int, part int, new int")
        rows = written(parted.join(F.broadcast(names), ["b", "part"]).select(F.col("new").alias("b"), "v", "n"), "brackets")
        wanted, size, offset, owner = new_wanted, new_size, new_offset, new_owner
    spec = local_frame(spark, [(b, x - offset[b], x) for b, xs in wanted.items() for x in xs], "b int, inside long, rank long")
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("b", "v", "n", upto.alias("upto")).join(F.broadcast(spec), "b").where(
        (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    value = {(owner[r["b"]], r["rank"]): r["v"] for r in placed.select("b", "rank", "v").collect()}
    out: dict = {}
    for i, r in enumerate(sizes):
        for p in probs:
            at = p * (r["rows"] - 1)
            lo, hi = value[(i, math.floor(at))], value[(i, math.ceil(at))]
            out.setdefault(_as_key(r["g"]), {})[p] = lo + (hi - lo) * (at - math.floor(at))
    return out


def _key_columns(freq: DataFrame) -> list:
    kind = freq.schema["g"].dataType
    return [F.col("g")[f.name] for f in kind.fields] if hasattr(kind, "fields") else [F.col("g")]


def _key_schema(freq: DataFrame) -> str:
    kind = freq.schema["g"].dataType
    types = [f.dataType for f in kind.fields] if hasattr(kind, "fields") else [kind]
    return ", ".join(f"k{k} {t.simpleString()}" for k, t in enumerate(types)) + ", b int"


def _parts(g) -> tuple:
    return tuple(g) if isinstance(g, tuple) else (g,)


def _as_key(g):
    return tuple(g) if isinstance(g, tuple) else g


def exact_quantiles(vals: DataFrame, group_col: str, value_col: str, probs: list[float]) -> DataFrame:
    """(group, prob, value) for every group of ``vals`` (non-null values only)."""
    freq = vals.where(F.col(value_col).isNotNull()).groupBy(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"))
    found = weighted_quantiles(written(freq.agg(F.count(F.lit(1)).alias("n")), "frequencies"), tuple(probs))
    kind = vals.schema[group_col].dataType.simpleString()
    return local_frame(vals.sparkSession, [(g, p, v) for g, ps in found.items() for p, v in ps.items()],
                       f"{group_col} {kind}, prob double, value double")
