"""Split a wide table into the modelled dimension and fact tables.

* Dimensions: rows with a NULL natural key are dropped, then the *first* row (by explicit order columns)
  of every natural key is kept, in two phases: the least order value per key, then the rows that have it. The
  order of a whole row is one fixed-width number, so the first phase is a hash aggregate with map-side
  combine (a natural key holding a third of all rows is one entry per task; nothing is sorted), and the
  second joins on key *and* order value, which spreads such a key over all partitions. The row hash of the
  source row and its order value are computed once, when the input is written.
* Facts: one narrow ``select`` per input row. Surrogate keys are SHA-256 over the natural key text, a
  pure function of the row, so foreign keys are computed inline — no join, no shuffle.
* The date dimension holds the distinct calendar dates of every date column.
"""

from __future__ import annotations

import datetime as _dt
import warnings
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from starweave.functions.calendar import calendar_columns
from starweave.functions.hashing import hash_columns, hash_frame_columns
from starweave.operators.model import DATE_DIMENSION, FACT_SK, MAIN_SK, Model, ModelTable
from starweave.operators.profile import is_missing, parse_timestamp
from starweave.session import HASH_TEXT, written

ROW_HASH = "__row_hash"
ORDER = "__order"  # prefix of the order columns
# Hex digits of the row hash next to an order column, and without one (60 and 120 bits).
TIE_DIGITS, HASH_DIGITS = 15, 30


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class SplitContext:
    """Run-level constants stamped on every output row (one ``load_ts`` literal per run)."""

    source_name: str
    load_ts: _dt.datetime

    def metadata(self, row_hash: Column) -> list[Column]:
        return [
            F.lit(self.load_ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("LOAD_TS"),  # zone-free literal
            F.lit(self.source_name).alias("SOURCE_FILE_NAME"),
            row_hash.alias("ROW_HASH"),
            F.lit(self.source_name).alias("RECORD_SOURCE"),
        ]


def source_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that this module adds."""
    return df.drop(*[c for c in df.columns if c == ROW_HASH or c.startswith(ORDER)])


def row_hash(df: DataFrame) -> Column:
    """SHA-256 over the canonical text of all source columns (read, not computed, where ``with_row_hash`` added it)."""
    return F.col(ROW_HASH) if ROW_HASH in df.columns else hash_frame_columns(df, source_columns(df).columns)


def with_row_hash(df: DataFrame) -> DataFrame:
    """``df`` with the hash of each row, so that what is written once need not be hashed for every table."""
    return df.withColumn(ROW_HASH, row_hash(df))


def surrogate_key(df: DataFrame, columns: list[str]) -> Column:
    return hash_frame_columns(df, columns)


def _hash_number(start: int, digits: int) -> Column:
    """Hex digits of the row hash as a number that orders like their text."""
    part = lambda at, n: F.conv(F.substring(ROW_HASH, at, n), 16, 10).cast("decimal(38,0)")
    if digits <= TIE_DIGITS:
        return part(start, digits)
    return part(start, TIE_DIGITS) * F.lit(Decimal(16 ** (digits - TIE_DIGITS))) + part(start + TIE_DIGITS, digits - TIE_DIGITS)


def _whole_number(c: Column, dtype: T.DataType) -> Column | None:
    """An order value as a 64-bit number of the same order; None for types that have none."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    return F.unix_micros(c) if isinstance(dtype, T.TimestampType) else None


def with_order(df: DataFrame, order_by: list[str] | str | None = None) -> DataFrame:
    """Attach the order that defines a natural key's "first" row: the given columns (NULL first), then the row's hash.

    One whole-numbered, date or timestamp column and the hash's first 60 bits make one 38-digit decimal. Otherwise
    every order column is a level of its own, followed by 120 bits of the hash. Ties of the given columns are thus
    decided by the rows themselves, so the same rows are first in every run. Without columns the order is that of the
    row hashes alone, which is repeatable but not the order of the file; a warning says so. A frame that has this very order
    already (its column says by what) stays as it is.
    """
    if isinstance(order_by, str):
        order_by = [order_by]
    first = f"{ORDER}0"
    if order_by and first in df.columns and df.schema[first].metadata.get("order_by") == list(order_by):
        return df
    if not order_by:
        warnings.warn("no order columns: the first row of a natural key is the one with the least row hash", stacklevel=3)
    out = with_row_hash(df.drop(*[c for c in df.columns if c.startswith(ORDER)]))
    whole = _whole_number(_q(order_by[0]), df.schema[order_by[0]].dataType) if order_by and len(order_by) == 1 else None
    if whole is not None:
        least = F.lit(Decimal(-2 ** 63 - 1)).cast("decimal(20,0)")  # NULL comes before every value
        value = F.coalesce(whole.cast("decimal(20,0)"), least).cast("decimal(38,0)")
        scaled = (value * F.lit(Decimal(16 ** TIE_DIGITS))).cast("decimal(38,0)")
        out = out.withColumn(first, (scaled + _hash_number(1, TIE_DIGITS)).cast("decimal(38,0)"))
        return out.withMetadata(first, {"order_by": list(order_by)})  # such a level is never NULL
    names = list(order_by or [])
    levels = {f"{ORDER}{i}": _q(c) for i, c in enumerate(names)}
    return out.withColumns({**levels, f"{ORDER}{len(names)}": _hash_number(1, HASH_DIGITS).cast("decimal(38,0)")})


def _date_of(df: DataFrame, column: str) -> Column:
    return F.to_date(parse_timestamp(_q(column), df.schema[column].dataType))


def date_key(d: Column) -> Column:
    return hash_columns([d.cast("string")])


def _first_rows(rows: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """The rows that are first among those of their key: least in the first level, among these in the second, ...

    Per level one aggregate of fixed-width values and one equality join with its result (one row per key; AQE
    broadcasts it only when its measured size allows). Rows left over several times are equal in all their columns, levels
    included. Where a level cannot be NULL the rows are shuffled by key and level, once for the join and the removal of
    such copies.
    """
    named, rows = rows.columns, rows.withColumn(ROW_HASH, F.unhex(ROW_HASH))  # half the bytes in the shuffles
    for level in levels:
        nullable = "order_by" not in rows.schema[level].metadata  # read from files, every column is declared nullable
        value = F.when(F.count(level) == F.count(F.lit(1)), F.min(level)) if nullable else F.min(level)
        least = rows.groupBy(*keys).agg(value.alias("__least"))
        least = least.select(*[F.col(k).alias(f"__least{k}") for k in keys], "__least")
        same = F.col(level).eqNullSafe(F.col("__least")) if nullable else F.col(level) == F.col("__least")
        for k in keys:
            same = same & (F.col(k) == F.col(f"__least{k}"))
        spread = rows if nullable else rows.repartition(*keys, level)
        rows = spread.join(least, same).select(*rows.columns)
    rows = rows.distinct().drop(*levels).withColumn(ROW_HASH, F.lower(F.hex(ROW_HASH)))
    return rows.select(*[c for c in named if c not in levels])


def build_dimension(df: DataFrame, table: ModelTable, ctx: SplitContext) -> DataFrame:
    """One row per non-null natural key: SK, ``<nk>_NK``, attributes of the first row, metadata."""
    if f"{ORDER}0" not in df.columns:
        df = with_order(df)
    nk = table.natural_key
    attrs = [c.source for c in table.columns if c.kind == "attribute"]
    src = source_columns(df)
    not_null = F.lit(True)
    for c in nk:  # NaN is a missing value, too
        not_null = not_null & ~is_missing(_q(c), src.schema[c].dataType)
    levels = [c for c in df.columns if c.startswith(ORDER)]
    keys = [f"__key{i}" for i in range(len(nk))]
    rows = df.where(not_null).select(*[_q(c).alias(k) for c, k in zip(nk, keys)], *levels,
                                     *[_q(a).alias(f"__attr{i}") for i, a in enumerate(attrs)], ROW_HASH)
    first = _first_rows(rows, keys, levels)
    return first.select(
        hash_columns(keys, [src.schema[c].dataType for c in nk]).alias(f"{table.name}_SK"),
        *[F.col(k).alias(f"{c}_NK") for c, k in zip(nk, keys)],
        *[F.col(f"__attr{i}").alias(a) for i, a in enumerate(attrs)],
        *ctx.metadata(F.col(ROW_HASH)),
    )


def build_date_dimension(df: DataFrame, date_columns: list[str], ctx: SplitContext) -> DataFrame:
    """Distinct calendar dates over all date columns, with calendar attributes."""
    dates = df.select(F.explode(F.array(*[_date_of(df, c) for c in date_columns])).alias("DATE_NK"))
    d = dates.where(F.col("DATE_NK").isNotNull()).distinct()
    cal = calendar_columns(F.col("DATE_NK"))
    out = d.select(date_key(F.col("DATE_NK")).alias("DATE_SK"), "DATE_NK", *cal)
    attrs = [c for c in out.columns if c != "DATE_SK"]
    return out.select("*", *ctx.metadata(hash_frame_columns(out, attrs)))


def _fk_expr(df: DataFrame, nk: list[str]) -> Column:
    cond = F.lit(True)
    for c in nk:
        cond = cond & ~is_missing(_q(c), df.schema[c].dataType)
    return F.when(cond, surrogate_key(df, nk))


def build_fact(df: DataFrame, model: Model, table: ModelTable, ctx: SplitContext) -> DataFrame:
    """One output row per input row; a single projection (no shuffle)."""
    src = source_columns(df)
    cols: list[Column] = []
    for c in table.columns:
        if c.kind == "sk" and c.is_pk:
            basis = model.fact_sk_columns  # the first five source columns, for FACT_SK and MAIN_SK alike
            cols.append(surrogate_key(src, basis).alias(c.name))
        elif c.kind in ("pk", "measure", "attribute"):
            cols.append(_q(c.source).alias(c.name))
        elif c.kind == "date_fk":
            d = _date_of(src, c.source)
            cols.append(F.when(d.isNotNull(), date_key(d)).alias(c.name))
        elif c.kind == "fk":
            cols.append(_fk_expr(src, model.tables[c.references].natural_key).alias(c.name))
    return df.select(*cols, *ctx.metadata(row_hash(df)))


def split(
    df: DataFrame,
    model: Model,
    source_name: str,
    order_by: list[str] | str | None = None,
    load_ts: _dt.datetime | None = None,
    cache_input: bool = True,
) -> dict[str, DataFrame]:
    """Lazy frames for every model table, dimensions first (nothing runs until they are written or
    checked). With ``cache_input`` the input, its row hashes and their order are written to the shared folder first, since every
    table reads them."""
    ctx = SplitContext(source_name, load_ts or _dt.datetime.now().replace(microsecond=0))
    if cache_input and len(model.tables) > 1:
        # every dimension (twice) and the fact read it
        df = written(with_order(df, order_by) if order_by else with_row_hash(df), "split-input", **HASH_TEXT)
    ordered = with_order(df, order_by)
    out: dict[str, DataFrame] = {}
    for name, t in model.tables.items():
        if t.table_type != "DIM":
            continue
        if name == DATE_DIMENSION:
            out[name] = build_date_dimension(df, model.date_columns, ctx)
        else:
            out[name] = build_dimension(ordered, t, ctx)
    for name, t in model.tables.items():
        if t.table_type == "FACT":
            out[name] = build_fact(df, model, t, ctx)
    return out


def resolve_fk(fact: DataFrame, dim: DataFrame, nk_columns: list[str], dim_nk_columns: list[str], sk_column: str,
               fk_name: str) -> DataFrame:
    """Foreign key against an *existing* dimension: left join on the natural key (a NULL or unknown key
    gives a NULL FK). The dimension side is distinct on its key, so the join never multiplies fact rows;
    AQE broadcasts it when its measured size allows, else sort-merges and splits skewed partitions."""
    keys = dim.select(*[F.col(f"`{d}`").alias(f"__nk{i}") for i, d in enumerate(dim_nk_columns)],
                      F.col(f"`{sk_column}`").alias(fk_name)).dropDuplicates([f"__nk{i}" for i in range(len(dim_nk_columns))])
    cond = None
    for i, c in enumerate(nk_columns):
        e = fact[f"`{c}`"] == keys[f"__nk{i}"]
        cond = e if cond is None else cond & e
    return fact.join(keys, cond, "left").drop(*[f"__nk{i}" for i in range(len(dim_nk_columns))])
