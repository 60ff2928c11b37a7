"""Candidate keys: single columns and column pairs whose distinct share of the rows is >= 0.95.

Singles come straight from the column profile. A pair is a key only if at most 5 % of its rows are duplicates, and most pairs
are shown not to be without being counted in full:
 * ``d(a) * d(b) < 0.95 * n`` (NULL counts as one more value), from the profile;
 * the sum of ``min(count(v), d(b))`` over the values v of a, which bounds the pairs that occur, from the frequency table;
 * the duplicates within a few slices of the hash space of one column of the pair are exact, and are duplicates of the whole.

A pair containing a column whose values (NULL included) are all different has exactly n values. The others are counted in
``ROUNDS`` scans of the table, and a pair leaves as soon as its duplicates exceed 5 % of all rows, so only (near) keys are ever
counted in full. Each pair is led by that of its columns whose most frequent value has fewer rows. A row is shuffled once for
each leading column, by its value, with the values of the columns that are paired with it; the rows of a value
then stand together and their distinct pairs are counted in numpy, chunk by chunk. Where even the leading column has a value of
more than ``GROUP_ROWS`` rows, or the table has more than ``LED_PAIRS`` such pairs, a row emits one entry for each such pair instead, and the entries are counted by an aggregate, which
collapses hot values.

So that rows are short in the shuffle, a column is written there as a code of few bits that no two of its values share: whole numbers,
days and decimals of few digits as the distance from the least value, others as the low bits of a hash. The frequency table, which
holds every value, tells which codes are possible, and codes share 64-bit words. Values of columns without such a code, and all
values of entries, are told apart by 128 bits of hashes of typed values (``('a|b','c')`` differs from ``('a','b|c')``); NULL is a value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from starweave.functions.frames import local_frame
from starweave.operators.profile import FAMILY_FIELDS, Profile, family_value, is_missing, type_family
from starweave.session import ship

# Fixed value: share of distinct values over rows for a candidate key.
MIN_UNIQUENESS = 0.95

# Hash slices counted in each round (of SLICES).
SLICES = 32
ROUNDS = ((0, 3), (3, 9), (9, 32))

# Most rows of one value of a leading column, and rows that a task counts at once.
GROUP_ROWS = 100_000
# Most pairs of a table counted by leading columns: their plan has an expression for each.
LED_PAIRS = 256
CHUNK_ROWS = 500_000

# Most decimal digits of a fractional column that is coded by its distance from the least value, and its greatest value
# times their power of ten; most values of a column that is coded by a hash.
DIGITS = 4
EXACT = 10.0 ** 15
HASHED_VALUES = 1 << 24
_NO_STEP = 99
_STEPS = (86_400_000_000, 1_000_000, 1)  # microseconds: a timestamp is coded in whole days, seconds or microseconds


def _spans() -> list[Column]:
    """Aggregates of a column's values: least and greatest whole number (or day, microsecond) and fractional value, and the finest
    step that a value needs (decimal digits, place in ``_STEPS``; ``_NO_STEP``: none will do)."""
    d, day, micros = F.col("value.d"), F.col("value.tn").cast("date"), F.unix_micros("value.tz")
    whole = F.coalesce("value.l", F.unix_date("value.dt"), F.unix_date(day), micros)
    digits = F.coalesce(*[F.when(F.rint(d * 10.0 ** s) / 10.0 ** s == d, s) for s in range(DIGITS + 1)], F.when(d.isNotNull(), _NO_STEP))
    of_zone = F.coalesce(*[F.when(F.pmod(micros, F.lit(step)) == 0, i) for i, step in enumerate(_STEPS)])
    step = F.coalesce(digits, of_zone, F.when(day.cast("timestamp_ntz") != F.col("value.tn"), _NO_STEP))
    return [F.min(whole).alias("least"), F.max(whole).alias("greatest"), F.min(d).alias("d_least"), F.max(d).alias("d_greatest"),
            F.coalesce(F.max(step), F.lit(0)).alias("step")]


def _pair_bounds(profile: Profile, table: str, distinct: dict[str, int]) -> tuple[dict[str, dict[int, int]], dict[str, Row]]:
    """For each column and number of values t of another one: the most value pairs that the two can have; and for each
    column the rows of its most frequent value (``most``) and its ``_spans``."""
    limits = sorted(set(distinct.values()))
    sums = [F.sum(F.least("cnt", F.lit(t))).alias(f"t{i}") for i, t in enumerate(limits)]
    rows = profile.typed().where(F.col("table_name") == table).groupBy("column_name").agg(
        F.max("cnt").alias("most"), *_spans(), *sums).collect()  # one row per column
    return {r["column_name"]: {t: r[f"t{i}"] for i, t in enumerate(limits)} for r in rows}, {r["column_name"]: r for r in rows}


@dataclass(frozen=True)
class Code:
    """A number from 1 to 2 ** bits - 1 that no two values of a column share (0: NULL), made of the typed value."""

    bits: int
    of: Callable[[Column], Column]


def _distance(family: str, span: Row) -> Code | None:
    """The distance from the least value, if the column has one in whole steps."""
    step, least, greatest = span["step"], span["least"], span["greatest"]
    if family == "fractional" and step <= DIGITS and span["d_least"] is not None:
        power = 10.0 ** step
        if max(-span["d_least"], span["d_greatest"]) * power > EXACT:
            return None
        least, greatest = round(span["d_least"] * power), round(span["d_greatest"] * power)
        number = lambda v: F.rint(v * power).cast("long")
    elif family == "timestamp" and least is not None:
        unit = _STEPS[step]
        least, greatest = least // unit, greatest // unit
        number = lambda v: F.call_function("div", F.unix_micros(v), F.lit(unit))
    elif family in ("integral", "date", "timestamp_ntz") and step == 0 and least is not None:
        number = {"integral": lambda v: v, "date": F.unix_date, "timestamp_ntz": lambda v: F.unix_date(v.cast("date"))}[family]
    else:
        return None
    bits = (greatest - least + 1).bit_length()
    return Code(bits, lambda v: number(v).cast("long") - F.lit(least) + 1) if bits < 63 else None


def value_codes(profile: Profile, table: str, columns: list[str], distinct: dict[str, int], spans: dict[str, Row]) -> dict[str, Code]:
    """Codes of those of the columns that have one. ``distinct``: the number of values of each column, NULL not counted."""
    types = {c: profile.tables[table].schema[c].dataType for c in columns}
    codes = {c: code for c in columns if (code := _distance(type_family(types[c]), spans[c]))}
    bits = {c: 2 * distinct[c].bit_length() + 3 for c in columns if c not in codes and 0 < distinct[c] <= HASHED_VALUES}
    low = lambda c: lambda v: F.xxhash64(F.lit(1), v).bitwiseAND(F.lit((1 << bits[c]) - 1)) + 1
    if bits:
        of_column = F.coalesce(*[F.when(F.col("column_name") == c, low(c)(F.col(f"value.{FAMILY_FIELDS[type_family(types[c])]}"))) for c in bits])
        found = profile.typed().where((F.col("table_name") == table) & F.col("column_name").isin(list(bits)) & F.col("value").isNotNull()) \
            .select("column_name", of_column.alias("code")).distinct().groupBy("column_name").count().collect()  # one row per column
        codes |= {r["column_name"]: Code(bits[r["column_name"]] + 1, low(r["column_name"])) for r in found
                  if r["count"] == distinct[r["column_name"]]}
    return codes


def _value_code(df: DataFrame, column: str, code: Code) -> Column:
    col, kind = F.col(f"`{column}`"), df.schema[column].dataType
    return F.when(is_missing(col, kind), F.lit(0).cast("long")).otherwise(code.of(family_value(col, kind, type_family(kind))))


def _value_hash(df: DataFrame, column: str, seed: int) -> Column:
    col, kind = F.col(f"`{column}`"), df.schema[column].dataType
    return F.when(is_missing(col, kind), F.lit(seed).cast("long")).otherwise(
        F.xxhash64(F.lit(seed), family_value(col, kind, type_family(kind))))


def slice_counts(df: DataFrame, pairs: list[tuple[int, str, str]], lo: int, hi: int) -> DataFrame:
    """(pair, distinct, rows) within the hash slices lo..hi-1 of each (number, column, column): one scan for all pairs.

    Two hashes of each value are computed once a row; a pair of values is told apart by 128 bits made of them.
    """
    columns = sorted({c for _, a, b in pairs for c in (a, b)})
    at = {c: i for i, c in enumerate(columns)}
    hashes = lambda seed: F.array(*[_value_hash(df, c, seed) for c in columns])
    listed = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(at[a]).alias("a"), F.lit(at[b]).alias("b")) for i, a, b in pairs])
    rows = df.select(hashes(1).alias("h"), hashes(2).alias("g")).select("h", "g", F.explode(listed).alias("p"))
    both = lambda h, *seed: F.xxhash64(*seed, F.get(h, F.col("p.a")), F.get(h, F.col("p.b")))
    rows = rows.select("p.pair", both("h").alias("x"), both("g", F.lit(3)).alias("y")).filter(
        F.pmod("x", F.lit(SLICES)).between(lo, hi - 1))
    counted = rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("pair").agg(F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("rows"))


def _led(pairs: list[tuple[int, str, str]]) -> dict[str, list[tuple[int, str]]]:
    """For each leading column its pairs: (number, other column)."""
    leads: dict[str, list[tuple[int, str]]] = {}
    for i, a, b in pairs:
        leads.setdefault(a, []).append((i, b))
    return leads


@dataclass(frozen=True)
class Field:
    """Where a value stands in a shuffled row: number of the 64-bit word, lowest bit, bits."""

    word: int
    shift: int
    bits: int


def _layout(lead: int, others: list[int]) -> list[Field]:
    """Places for values of so many bits each in few words: the leading one in the lowest bits of the first word, the others, longest
    first, each in the first word that has room."""
    used = [lead]
    fields: dict[int, Field] = {}
    for i in sorted(range(len(others)), key=lambda i: -others[i]):
        word = next((w for w, u in enumerate(used) if u + others[i] <= 64), len(used))
        if word == len(used):
            used.append(0)
        fields[i] = Field(word, used[word], others[i])
        used[word] += others[i]
    return [Field(0, 0, lead), *(fields[i] for i in range(len(others)))]


def _words(values: list[Column], fields: list[Field], count: int) -> list[Column]:
    words: list[list[Column]] = [[] for _ in range(count)]
    for value, f in zip(values, fields):
        words[f.word].append(F.shiftleft(value, f.shift) if f.shift else value)
    return [reduce(Column.bitwiseOR, parts, parts.pop(0)) if parts else F.lit(0).cast("long") for parts in words]


def _mask(f: Field) -> int:
    return (1 << f.bits) - 1 if f.bits < 64 else -1


def _group_counter(numbers: list[list[int]], places: list[tuple[Field, list[Field], Field | None]] | None = None,
                   ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (lead, words...) in the order of the leading value x: for pair number numbers[lead][i] the distinct (x, yi), and the rows.

    ``places``: for each lead the fields of x (in the lowest bits of the first word) and of its y, and that of a second hash of the leading
    value where x is a hash and not a code. The words are x, y0, y1, ... if it is left out."""
    places = places or [(Field(0, 0, 64), [Field(i + 1, 0, 64) for i in range(len(own))], None) for own in numbers]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        distinct, rows = Counter(), Counter()
        masks = np.array([_mask(x) for x, _, _ in places], np.int64)

        def read(part: list, f: Field, at: np.ndarray) -> np.ndarray:
            return (part[2 + f.word][at] >> np.int64(f.shift)) & np.int64(_mask(f))

        def add(part: list) -> None:
            for lead, (pairs, (_, fields, second)) in enumerate(zip(numbers, places)):
                at = np.flatnonzero(part[0] == lead)
                if not len(at):
                    continue
                x = part[1][at]
                first = np.r_[True, x[1:] != x[:-1]]
                size = np.diff(np.r_[np.flatnonzero(first), len(x)])
                shared = np.repeat(size > 1, size)  # rows of values with several rows; the others are one pair each
                xs, at = x[shared], at[shared]
                other = read(part, second, at) if second else None
                for f, pair in zip(fields, pairs):
                    y = read(part, f, at)
                    y = y if other is None else y * np.int64(-4417276706812531889) + other
                    z = xs * np.int64(-7046029254386353131) + y  # equal pairs have equal z, so only equal z are looked at in full
                    ordered = np.sort(z)
                    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                    if len(twice):
                        found = np.minimum(np.searchsorted(twice, z), len(twice) - 1)
                        again = twice[found] == z
                        a, b = xs[again], y[again]
                        order = np.lexsort((b, a))
                        a, b = a[order], b[order]
                        distinct[pair] -= int(((a[1:] == a[:-1]) & (b[1:] == b[:-1])).sum())
                    distinct[pair] += len(x)
                    rows[pair] += len(x)

        held: list[list] = []

        def whole(last: bool) -> None:
            """Count what is held, except (unless it is the last) the rows of the greatest x, of which more may come."""
            part = [np.concatenate(c) for c in zip(*held)]
            cut = len(part[1]) if last else int(np.searchsorted(part[1], part[1][-1]))
            add([c[:cut] for c in part])
            held[:] = [] if last else [[c[cut:] for c in part]]

        for batch in batches:
            if batch.num_rows:
                lead, first, *others = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held.append([lead, first & masks[lead], first, *others])
                if sum(len(c[0]) for c in held) >= CHUNK_ROWS:
                    whole(False)
        if held:
            whole(True)
        found = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([distinct[p] for p in found], pa.int64()),
                                          pa.array([rows[p] for p in found], pa.int64())], names=["pair", "distinct", "rows"])
    return count


def lead_counts(df: DataFrame, pairs: list[tuple[int, str, str]], lo: int, hi: int, codes: dict[str, Code] | None = None) -> DataFrame:
    """``slice_counts`` by leading columns (each pair's first): slices lo..hi-1 of the hash space of the leading values.

    ``codes``: what is written of the columns that have a code; of others, a hash of 64 bits, and of leading ones two of them.
    """
    ship(df.sparkSession)
    codes = codes or {}
    leads = _led(pairs)
    value = lambda c: _value_code(df, c, codes[c]) if c in codes else _value_hash(df, c, 1)
    bits = lambda c: codes[c].bits if c in codes else 64
    places, parts = [], []
    for lead, own in leads.items():
        x, *fields = _layout(bits(lead), [bits(b) for _, b in own] + ([] if lead in codes else [64]))
        places.append((x, fields[:len(own)], None if lead in codes else fields[-1]))
    width = max(f.word + 1 for x, fields, second in places for f in [x, *fields, *([second] if second else [])])
    for k, ((lead, own), (x, fields, second)) in enumerate(zip(leads.items(), places)):
        values, at = [value(lead), *(value(b) for _, b in own)], [x, *fields]
        if second:
            values, at = [*values, _value_hash(df, lead, 2)], [*at, second]
        names = ["x", *(f"y{i}" for i in range(width - 1))]
        parts.append(df.where(F.pmod(_value_hash(df, lead, 1), F.lit(SLICES)).between(lo, hi - 1)).select(
            F.lit(k).alias("lead"), *[w.alias(name) for w, name in zip(_words(values, at, width), names)]))
    masks = [_mask(x) for x, _, _ in places]
    x = F.col("x") if set(masks) == {-1} else F.col("x").bitwiseAND(F.get(F.array(*[F.lit(m).cast("long") for m in masks]), "lead"))
    rows = reduce(DataFrame.unionByName, parts).repartition(x).sortWithinPartitions(x)
    counted = rows.mapInArrow(_group_counter([[i for i, _ in own] for own in leads.values()], places), "pair int, distinct long, rows long")
    return counted.groupBy("pair").agg(F.sum("distinct").alias("distinct"), F.sum("rows").alias("rows"))


def pair_distinct_counts(df: DataFrame, pairs: list[tuple[str, str]], n: int, min_uniqueness: float,
                         most: dict[str, int], codes: dict[str, Code] | None = None) -> dict[tuple[str, str], int]:
    """Distinct values of those pairs that reach ``min_uniqueness`` of the ``n`` rows; the others are left out.

    ``most``: for each column the rows of its most frequent value."""
    distinct, duplicates = {p: 0 for p in pairs}, {p: 0 for p in pairs}
    by_entry = lambda p: len(pairs) > LED_PAIRS or most[p[1]] > GROUP_ROWS  # noqa: E731 - the same in all rounds
    for lo, hi in ROUNDS:
        left = list(distinct)
        led = [(i, *sorted(p, key=most.__getitem__)) for i, p in enumerate(left)]
        hot = [p for p in led if by_entry(p)]
        cool = [p for p in led if not by_entry(p)]
        for count, some in ((partial(lead_counts, codes=codes), cool), (slice_counts, hot)):
            for r in count(df, some, lo, hi).collect() if some else []:  # one row per pair
                distinct[left[r["pair"]]] += r["distinct"]
                duplicates[left[r["pair"]]] += r["rows"] - r["distinct"]
        distinct = {p: d for p, d in distinct.items() if n - duplicates[p] >= min_uniqueness * n}
    return distinct


def candidate_keys(profile: Profile, min_uniqueness: float = MIN_UNIQUENESS, pairs: bool = True) -> DataFrame:
    """Candidate keys of every profiled table, with ``key_rank`` = order by uniqueness (4 decimals)
    descending, singles before pairs, then column order."""
    spark = profile.spark
    cp_rows = profile.column_profile().select(
        "table_name", "column_name", "ordinal", "total_rows", "null_count", "distinct_count"
    ).collect()  # one row per column: metadata-sized
    by_table: dict[str, list] = {}
    for r in cp_rows:
        by_table.setdefault(r["table_name"], []).append(r)
    rows = []
    for table, cols in by_table.items():
        cols.sort(key=lambda r: r["ordinal"])
        n = cols[0]["total_rows"] if cols else 0
        for r in cols:
            u = r["distinct_count"] / n if n else 0.0
            if u >= min_uniqueness:
                rows.append((table, "single", r["column_name"], None, r["ordinal"], None,
                                    r["distinct_count"], r["null_count"]))
        if not pairs or n == 0:
            continue
        to_count = []
        values = {r["column_name"]: r["distinct_count"] + (1 if r["null_count"] else 0) for r in cols}
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                da, db = values[a["column_name"]], values[b["column_name"]]
                if da == n or db == n:
                    rows.append((table, "composite", a["column_name"], b["column_name"], a["ordinal"],
                                        b["ordinal"], n, None))
                elif da * db >= min_uniqueness * n:
                    to_count.append((a, b))
        if to_count:
            bounds, spans = _pair_bounds(profile, table, values)
            bound = lambda a, b: min(bounds[a][values[b]], bounds[b][values[a]])
            to_count = [(a, b) for a, b in to_count if bound(a["column_name"], b["column_name"]) >= min_uniqueness * n]
        names = [(a["column_name"], b["column_name"]) for a, b in to_count]
        found = {}
        if names:
            counted = {r["column_name"]: r["distinct_count"] for r in cols}
            codes = value_codes(profile, table, sorted({c for p in names for c in p}), counted, spans) if len(names) <= LED_PAIRS else {}
            most = {c: r["most"] for c, r in spans.items()}
            found = pair_distinct_counts(profile.tables[table], names, n, min_uniqueness, most, codes)
        rows += [(table, "composite", *names[k], a["ordinal"], b["ordinal"], found[names[k]], None)
                 for k, (a, b) in enumerate(to_count) if names[k] in found]
    totals = local_frame(spark, 
        [(t, cols[0]["total_rows"]) for t, cols in by_table.items() if cols], "table_name string, total_rows long"
    )
    keys = local_frame(spark, 
        rows,
        "table_name string, key_type string, column_1 string, column_2 string, ordinal_1 int, ordinal_2 int, "
        "distinct_count long, null_count long",
    )
    keys = keys.join(F.broadcast(totals), "table_name").select(
        "table_name", "key_type", "column_1", "column_2", "ordinal_1", "ordinal_2",
        F.round(F.when(F.col("total_rows") > 0, F.col("distinct_count") / F.col("total_rows")).otherwise(0.0), 4)
        .alias("uniqueness"),
        "distinct_count", "null_count",
    ).where(F.col("distinct_count") >= F.lit(min_uniqueness) * F.col("total_rows"))
    order = Window.partitionBy("table_name").orderBy(
        F.desc("uniqueness"), F.when(F.col("key_type") == "single", 0).otherwise(1), "ordinal_1", "ordinal_2"
    )
    ranked = keys.withColumn("key_rank", F.row_number().over(order))
    # The key list is metadata-sized (at most columns² / 2 rows per table): computed once, then reused by
    # the model, the table profile and reports without re-counting pairs.
    return local_frame(spark, [tuple(r) for r in ranked.collect()], ranked.schema)


def key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("table_name").agg(F.count(F.lit(1)).alias("candidate_key_count"))
