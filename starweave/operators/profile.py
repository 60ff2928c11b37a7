"""Column profiling as Spark aggregates.

One frequency table ``(table_name, column_name, value, cnt)`` — every column of every table unpivoted
to a typed key and counted with map-side partial aggregation — answers totals, null counts, distinct
counts, top values, entity ratios, numeric statistics and anomalies. It is counted once, written to the shared
folder and read from there; a question about some columns only counts those.

Text values longer than ``LONG_VALUE`` characters are carried as a ``#``-prefixed SHA-256 digest, so long texts are
counted exactly without moving their bytes. Which form a value takes changes no result: ranks break ties by the
SHA-256 digest of the value, whatever its length. NaN counts as a missing value, like NULL.

Numeric quantiles are exact (``quantiles``); date and length statistics are single-pass global aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from starweave.functions.rules import DATE_FORMATS, entity_role_expr, grain_expr, logical_type_expr, name_prefix_expr
from starweave.functions.types import logical_type_of, warehouse_type_of
from starweave.functions.frames import local_frame
from starweave.operators.quantiles import weighted_quantiles
from starweave.session import written

# Longest value carried as text; profile thresholds used by the anomaly report.
LONG_VALUE = 64
_DIGEST_KEY = 65  # length of the key of a longer value: "#" and the hexadecimal digest
TOP_K = 10
HIGH_NULL_PCT = 50.0
HIGH_OUTLIER_PCT = 10.0
ISSUE_HIGH_NULLS = "High null percentage"
ISSUE_HIGH_OUTLIERS = "High outlier percentage"
ISSUE_CONSTANT = "Constant value (no variation)"
HISTOGRAM_BINS = 50
IQR_FACTOR = 1.5

_META_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("spark_type", T.StringType(), False),
        T.StructField("physical_kind", T.StringType(), False),
        T.StructField("warehouse_type", T.StringType(), False),
    ]
)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def column_metadata(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table: name, position, Spark type and logical type (by name, then type)."""
    rows = [
        (t, f.name, i + 1, f.dataType.simpleString(), logical_type_of(f.dataType), warehouse_type_of(f.dataType))
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    meta = local_frame(spark, rows, _META_SCHEMA)
    return meta.withColumn("logical_type", logical_type_expr(F.col("column_name"), F.col("physical_kind")))


def value_key(c: Column, data_type: T.DataType) -> Column:
    """Text key of a value for exact distinct counting (NULL stays NULL)."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 and 0.0 are one value
    txt = c.cast("string")
    return F.when(F.length(txt) > LONG_VALUE, F.concat(F.lit("#"), F.sha2(txt, 256))).otherwise(txt)


# Values are counted in their own type where one exists (hashing a long or a double is far cheaper than
# formatting it as text); everything else — strings, booleans, decimals, arrays, structs — as text keys.
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def type_family(dt: T.DataType) -> str:
    if isinstance(dt, _INTEGRAL):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "fractional"
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp_ntz"
    if isinstance(dt, T.TimestampType):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    return "text"


# A value in the frequency table: a struct with one field per family, only the column's own field set (NULL struct for a
# NULL value), so that the values of all columns of all tables stand in one table.
_KEY_FIELDS = (("integral", "l", "bigint"), ("fractional", "d", "double"), ("timestamp_ntz", "tn", "timestamp_ntz"),
               ("timestamp", "tz", "timestamp"), ("date", "dt", "date"), ("text", "s", "string"))
FAMILY_FIELDS = {family: name for family, name, _ in _KEY_FIELDS}


def family_value(c: Column, dt: T.DataType, family: str) -> Column:
    if family == "integral":
        return c.cast("long")
    if family == "fractional":
        return F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
    if family == "text":
        return value_key(c, dt)
    return c


def is_missing(c: Column, dt: T.DataType) -> Column:
    """NULL, or NaN of a floating-point column."""
    return (c.isNull() | F.isnan(c)) if isinstance(dt, (T.FloatType, T.DoubleType)) else c.isNull()


def _unpivot_family(df: DataFrame, fields: list[tuple[int, T.StructField]], family: str) -> DataFrame:
    """(number, v) of the given numbered columns, all of one family."""
    values = [F.when(~is_missing(_q(f.name), f.dataType), family_value(_q(f.name), f.dataType, family)).alias(str(i))
              for i, f in fields]
    long = df.select(*values).unpivot([], [str(i) for i, _ in fields], "number", "v")
    return long.select(F.col("number").cast("int").alias("number"), "v")


def typed_frequencies(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value struct, cnt) over all columns of all tables; NULL is its own value.

    The columns of one family are counted together under the key (number of the column, value in its own type): a
    fixed-width key except for texts, so that a row of a near-unique column costs some 30 bytes of the aggregation's memory
    and of the shuffle. Map-side partial aggregation collapses repeated values before the shuffle, so a value held by a
    third of all rows costs one row per map task.
    """
    columns = [(name, f) for name, df in tables.items() for f in df.schema.fields]
    names = [F.get(F.array(*[F.lit(x) for x in xs]), F.col("number")) for xs in
             ([t for t, _ in columns], [f.name for _, f in columns])]
    out = None
    for family, field_name, _ in _KEY_FIELDS:
        long = None
        for name, df in tables.items():
            own = [(i, f) for i, (t, f) in enumerate(columns) if t == name and type_family(f.dataType) == family]
            if own:
                part = _unpivot_family(df, own, family)
                long = part if long is None else long.unionByName(part)
        if long is None:
            continue
        value = F.struct(*[(F.col("v") if f == field_name else F.lit(None)).cast(kind).alias(f) for _, f, kind in _KEY_FIELDS])
        counted = long.groupBy("number", "v").agg(F.count(F.lit(1)).alias("cnt")).select(
            names[0].alias("table_name"), names[1].alias("column_name"), F.when(F.col("v").isNotNull(), value).alias("value"), "cnt")
        out = counted if out is None else out.unionByName(counted)
    return out


@dataclass
class Profile:
    """Profile frames of a set of tables. Frequencies are counted on first use and written; metadata-sized results
    (one row per column) are kept as local frames."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    metadata: DataFrame
    _cache: dict = field(default_factory=dict)

    def typed(self, logical: tuple[str, ...] | None = None) -> DataFrame:
        """Frequencies of all columns, or at least those of the given logical types."""
        if ("typed", None) in self._cache:
            return self._cache[("typed", None)]
        if ("typed", logical) not in self._cache:
            tables = self.tables
            if logical is not None:
                tables = {t: self.tables[t].select(*[_q(c) for c in cols]) for t, cols in self._columns_of(logical).items()}
            schema = "table_name string, column_name string, value struct<" + ", ".join(
                f"{name}: {kind}" for _, name, kind in _KEY_FIELDS) + ">, cnt long"
            self._cache[("typed", logical)] = (written(typed_frequencies(tables), "frequencies") if tables
                                               else local_frame(self.spark, [], schema))
        return self._cache[("typed", logical)]

    def _of_types(self, logical: tuple[str, ...]) -> DataFrame:
        """Frequencies of exactly the columns of the given logical types, with the column's position."""
        cols = self.metadata.where(F.col("logical_type").isin(*logical)).select("table_name", "column_name", "ordinal")
        return self.typed(logical).join(F.broadcast(cols), ["table_name", "column_name"])  # one row per column

    # ---- base profile (G1) --------------------------------------------------------------------------
    def column_profile(self) -> DataFrame:
        """Per column: logical type, rows, non-null / null counts and %, distinct count (NULL excluded) and %
        of rows — one aggregation of the frequency table, kept after the first call."""
        if "cp" in self._cache:
            return self._cache["cp"]
        per_col = self.typed().groupBy("table_name", "column_name").agg(
            F.sum("cnt").alias("total_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
        # ``per_col`` has one row per column: a bounded broadcast.
        cp = self.metadata.join(F.broadcast(per_col), ["table_name", "column_name"], "left")
        total = F.coalesce("total_rows", F.lit(0)).cast("long")
        nulls = F.coalesce("null_count", F.lit(0)).cast("long")
        distinct = F.coalesce("distinct_count", F.lit(0)).cast("long")
        pct = lambda x: F.when(total > 0, F.round(x * 100.0 / total, 2)).otherwise(F.lit(0.0))
        cp = cp.select(
            "table_name", "column_name", "ordinal", "spark_type", "warehouse_type", "logical_type",
            total.alias("total_rows"),
            (total - nulls).alias("non_null_count"),
            nulls.alias("null_count"),
            pct(nulls).alias("null_percentage"),
            distinct.alias("distinct_count"),
            pct(distinct).alias("distinct_percentage"),
        )
        # One row per column: computed once and kept as a literal frame, so the model, key and anomaly
        # steps that read it do not re-run the frequency aggregation.
        rows = [tuple(r) for r in cp.collect()]
        cp = local_frame(self.spark, rows, cp.schema)
        self._cache["cp"] = cp
        return cp

    # ---- entity roles (G10) and grain (G11) ---------------------------------------------------------
    def entity_roles(self) -> DataFrame:
        """Per column: ids / dates / facts / dimensions (or NULL) and the name prefix used for grouping."""
        cp = self.column_profile()
        return cp.select(
            "table_name", "column_name", "ordinal", "logical_type", "distinct_count", "total_rows",
            entity_role_expr(F.col("column_name"), F.col("logical_type"), F.col("distinct_count"), F.col("total_rows"))
            .alias("entity_role"),
            name_prefix_expr(F.col("column_name")).alias("name_prefix"),
        )

    def grain(self) -> DataFrame:
        """Per table: transaction / event / row_level, from column names alone."""
        return self.metadata.groupBy("table_name").agg(grain_expr(F.col("column_name")).alias("grain"))

    # ---- top values (G5, W1) and boolean counts (G6) ------------------------------------------------
    def top_value_keys(self, k: int = TOP_K, logical_types=("STRING",)) -> DataFrame:
        """Top ``k`` non-null value keys per column by count, ties by the SHA-256 digest of the value (ascending)."""
        freq = self._of_types(tuple(logical_types)).where(F.col("value.s").isNotNull()).select(
            "table_name", "column_name", F.col("value.s").alias("value_key"), F.col("cnt").alias("count"))
        is_digest = F.length("value_key") == _DIGEST_KEY
        digest = F.when(is_digest, F.substr(F.col("value_key"), F.lit(2))).otherwise(F.sha2("value_key", 256))
        w = Window.partitionBy("table_name", "column_name").orderBy(F.desc("count"), F.asc("digest"))
        top = freq.withColumn("digest", digest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return top.select("table_name", "column_name", "rank", "value_key", "count")

    def top_values(self, k: int = TOP_K, logical_types=("STRING",)) -> DataFrame:
        """``top_value_keys`` with the values themselves; ``k`` rows per column are kept as a local frame."""
        top = self.top_value_keys(k, logical_types)
        rows = top.collect()  # k rows per column
        top = local_frame(self.spark, [tuple(r) for r in rows], top.schema)
        wanted: dict[tuple[str, str], list[str]] = {}
        for r in rows:
            if len(r["value_key"]) == _DIGEST_KEY:
                wanted.setdefault((r["table_name"], r["column_name"]), []).append(r["value_key"])
        if not wanted:
            return top.withColumn("value", F.col("value_key"))
        parts = []  # long values: read again, only in the columns concerned
        for (t, c), keys in wanted.items():
            df = self.tables[t]
            key = value_key(_q(c), df.schema[c].dataType)
            parts.append(
                df.select(key.alias("value_key"), _q(c).cast("string").alias("raw"))
                .where(F.col("value_key").isin(keys))
                .groupBy("value_key").agg(F.min("raw").alias("raw"))
                .select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "value_key", "raw"))
        raw = _union(parts, self.spark, "table_name string, column_name string, value_key string, raw string")
        return top.join(raw, ["table_name", "column_name", "value_key"], "left").select(
            "table_name", "column_name", "rank", "value_key", F.coalesce("raw", "value_key").alias("value"), "count")

    def value_counts(self, logical_types=("BOOLEAN",)) -> DataFrame:
        """Count of every non-null value of the columns of the given logical types (booleans by default)."""
        return self._of_types(tuple(logical_types)).where(F.col("value.s").isNotNull()).select(
            "table_name", "column_name", F.col("value.s").alias("value"), F.col("cnt").alias("count"))

    # ---- type-specific statistics -------------------------------------------------------------------
    def _columns_of(self, logical: tuple[str, ...]) -> dict[str, list[str]]:
        meta = self.metadata.where(F.col("logical_type").isin(*logical)).select("table_name", "column_name", "ordinal")
        out: dict[str, list[tuple[int, str]]] = {}
        for r in meta.collect():  # one row per column: metadata-sized
            out.setdefault(r["table_name"], []).append((r["ordinal"], r["column_name"]))
        return {t: [c for _, c in sorted(v)] for t, v in out.items()}

    def numeric_profile(self, approx: bool = False, accuracy: int = 10000) -> DataFrame:
        """Min, max, mean, median, std, q1, q3 and IQR outliers per INTEGER/FLOAT column of every table,
        from the frequency table. ``approx=True`` uses ``approx_percentile`` sketches over the
        values instead (no shuffle of values; rank error at most 1/``accuracy`` of the rows)."""
        if approx:
            cols = self._columns_of(("INTEGER", "FLOAT"))
            parts = [
                _unpivot_numeric(self.tables[t], c).select(F.lit(t).alias("table_name"), "column_name", "v")
                for t, c in cols.items() if c
            ]
            return _approx_numeric_stats(_union(parts, self.spark, "table_name string, column_name string, v double"),
                                         accuracy)
        if "np" not in self._cache:
            v = F.coalesce(F.col("value.l").cast("double"), F.col("value.d"), F.expr("try_cast(value.s AS double)"))
            freq = self._of_types(("INTEGER", "FLOAT")).select("table_name", "column_name", v.alias("v"), F.col("cnt").alias("n"))
            self._cache["np"] = _numeric_stats(freq)
        return self._cache["np"]

    def date_profile(self) -> DataFrame:
        """Valid / invalid dates, min and max per DATE column of every table (one aggregate per table)."""
        parts = [date_profile(self.tables[t], cols, t) for t, cols in self._columns_of(("DATE",)).items()]
        return _union(parts, self.spark, _DATE_SCHEMA)

    def string_profile(self) -> DataFrame:
        """Average and maximum length per STRING column of every table (one aggregate per table)."""
        parts = [string_profile(self.tables[t], cols, t) for t, cols in self._columns_of(("STRING",)).items()]
        return _union(parts, self.spark, _STRING_SCHEMA)

    # ---- table profile (G9) and anomalies (P7) ------------------------------------------------------
    def table_profile(self, candidate_key_counts: DataFrame | None = None) -> DataFrame:
        """Per table: rows, columns, grain and (given ``keys.key_counts``) the number of candidate keys.

        Rows are counted by a scan without columns; no value is read."""
        counts = [df.agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(t).alias("table_name"), "total_rows")
                  for t, df in self.tables.items()]
        tp = _union(counts, self.spark, "table_name string, total_rows long").join(
            self.metadata.groupBy("table_name").agg(F.count(F.lit(1)).alias("total_columns"),
                                                    grain_expr(F.col("column_name")).alias("grain")), "table_name")
        if candidate_key_counts is not None:
            tp = tp.join(candidate_key_counts, "table_name", "left").withColumn(
                "candidate_key_count", F.coalesce("candidate_key_count", F.lit(0)).cast("long")
            )
        return tp

    def anomalies(self, outliers: DataFrame | None = None) -> DataFrame:
        """(table, column, issue, value): >50 % nulls, >10 % outliers, a single distinct value."""
        cp = self.column_profile()
        high_null = cp.where(F.col("null_percentage") > HIGH_NULL_PCT).select(
            "table_name", "column_name", F.lit(ISSUE_HIGH_NULLS).alias("issue"),
            F.format_string("%.2f%%", F.col("null_percentage")).alias("value"),
        )
        constant = cp.where(F.col("distinct_count") == 1).select(
            "table_name", "column_name", F.lit(ISSUE_CONSTANT).alias("issue"), F.lit("N/A").alias("value")
        )
        out = high_null.unionByName(constant)
        if outliers is None:
            outliers = self.numeric_profile()
        high_out = outliers.where(F.col("outlier_percentage") > HIGH_OUTLIER_PCT).select(
            "table_name", "column_name", F.lit(ISSUE_HIGH_OUTLIERS).alias("issue"),
            F.format_string("%.2f%%", F.col("outlier_percentage")).alias("value"),
        )
        return out.unionByName(high_out)

    def preview(self, table_name: str, n: int = 100) -> DataFrame:
        """The first ``n`` rows of a table (a limit is the feature here)."""
        return self.tables[table_name].limit(n)


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Profile:
    return Profile(spark, tables, column_metadata(spark, tables))


def profile_table(df: DataFrame, table_name: str = "input") -> Profile:
    return profile_tables(df.sparkSession, {table_name: df})


# ---- per-table statistics ---------------------------------------------------------------------------

_NUMERIC_SCHEMA = (
    "table_name string, column_name string, total_rows long, min double, max double, mean double, "
    "median double, std double, q1 double, q3 double, outlier_count long, outlier_percentage double"
)
_DATE_SCHEMA = (
    "table_name string, column_name string, valid_date_count long, invalid_date_count long, "
    "min_date string, max_date string"
)
_STRING_SCHEMA = "table_name string, column_name string, avg_length double, max_length int"


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return local_frame(spark, [], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unpivot_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, v double) for the given columns; nulls and non-numeric text become NULL."""
    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None)).alias("v"))
                  for c in columns])
    )
    return df.select(stacked.alias("kv")).select("kv.column_name", "kv.v")


def _numeric_stats(freq: DataFrame) -> DataFrame:
    """Statistics per column from (table_name, column_name, v, n): n rows hold the value v (NULL: missing).

    Three passes over the distinct values: moments, quartiles, then squared deviations and outliers. What they yield
    is one row per column, kept as a local frame.
    """
    spark = freq.sparkSession
    key = ["table_name", "column_name"]
    real = F.col("v").isNotNull()
    first = freq.groupBy(*key).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("n")).alias("s")).collect()
    quart = weighted_quantiles(freq.where(real).select(F.struct(*key).alias("g"), "v", "n"), (0.25, 0.5, 0.75))
    rows = []
    for r in first:
        q = quart.get((r["table_name"], r["column_name"]))
        mean = r["s"] / r["n"] if r["n"] else None
        step = IQR_FACTOR * (q[0.75] - q[0.25]) if q else None
        rows.append((r["table_name"], r["column_name"], r["total"], r["n"], r["min"], r["max"], mean, *(
            (q[0.25], q[0.5], q[0.75], q[0.25] - step, q[0.75] + step) if q else (None,) * 5)))
    base = local_frame(spark, rows, "table_name string, column_name string, total long, n_real long, min double, max double, "
                                    "mean double, q1 double, median double, q3 double, lo double, hi double")
    off = F.col("v") - F.col("mean")
    second = freq.where(real).join(F.broadcast(base), key).groupBy(*key).agg(  # one row per column
        F.sum(F.col("n") * off * off).alias("ss"),
        F.coalesce(F.sum(F.when((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.col("n"))), F.lit(0)).alias("out"))
    total, out = F.col("total"), F.coalesce("out", F.lit(0)).cast("long")
    stats = base.join(F.broadcast(second), key, "left").select(
        *key, total.alias("total_rows"), "min", "max", "mean", "median",
        F.when(F.col("n_real") > 1, F.sqrt(F.col("ss") / (F.col("n_real") - 1))).alias("std"), "q1", "q3",
        out.alias("outlier_count"),
        F.when(total > 0, F.round(out * 100.0 / total, 2)).otherwise(F.lit(0.0)).alias("outlier_percentage"))
    return local_frame(spark, [tuple(r) for r in stats.collect()], stats.schema)


def _approx_numeric_stats(vals: DataFrame, accuracy: int) -> DataFrame:
    """Like ``_numeric_stats`` with sketch quartiles: two partial-aggregated passes, no value shuffle."""
    q = F.percentile_approx("v", [0.25, 0.5, 0.75], accuracy)
    first = vals.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        q.alias("q"),
    ).select("*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).drop("q")
    iqr = F.col("q3") - F.col("q1")
    bounds = first.select("table_name", "column_name", (F.col("q1") - IQR_FACTOR * iqr).alias("lo"),
                          (F.col("q3") + IQR_FACTOR * iqr).alias("hi"))
    # One row per column: a bounded broadcast.
    outl = vals.join(F.broadcast(bounds), ["table_name", "column_name"]).groupBy("table_name", "column_name").agg(
        F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("outlier_count"))
    total = F.col("total_rows")
    return first.join(outl, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", "total_rows", "min", "max", "mean", "median", "std", "q1", "q3",
        F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
        F.when(total > 0, F.round(F.coalesce("outlier_count", F.lit(0)) * 100.0 / total, 2))
        .otherwise(F.lit(0.0)).alias("outlier_percentage"))


def parse_timestamp(c: Column, data_type: T.DataType) -> Column:
    """Timestamp of a date-like column: temporal types as is, text parsed (failures NULL), numbers NULL."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz") if isinstance(data_type, T.TimestampType) else c
    if isinstance(data_type, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(data_type, T.StringType):
        t = F.trim(c)
        parsed = [F.try_to_timestamp(t)] + [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
        return F.coalesce(*parsed).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def date_profile(df: DataFrame, columns: list[str], table_name: str = "input") -> DataFrame:
    """valid / invalid (= rows - valid) date counts, min and max per DATE column; one global aggregate."""
    if not columns:
        return local_frame(df.sparkSession, [], _DATE_SCHEMA)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        ts = parse_timestamp(_q(c), types[c])
        aggs += [F.count(ts).alias(f"v{i}"), F.min(ts).alias(f"lo{i}"), F.max(ts).alias(f"hi{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"v{i}").alias("valid_date_count"),
            (F.col("__n") - F.col(f"v{i}")).alias("invalid_date_count"),
            F.col(f"lo{i}").cast("string").alias("min_date"),
            F.col(f"hi{i}").cast("string").alias("max_date"),
        )
        for i, c in enumerate(columns)
    ]))
    return one.select(rows.alias("r")).select(F.lit(table_name).alias("table_name"), "r.*")


def string_profile(df: DataFrame, columns: list[str], table_name: str = "input") -> DataFrame:
    """Average (2 decimals) and maximum length of the non-null values; one global aggregate."""
    if not columns:
        return local_frame(df.sparkSession, [], _STRING_SCHEMA)
    aggs = []
    for i, c in enumerate(columns):
        ln = F.length(_q(c).cast("string"))
        aggs += [F.round(F.avg(ln), 2).alias(f"a{i}"), F.max(ln).alias(f"m{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.col(f"a{i}"), F.lit(0.0)).alias("avg_length"),
            F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("max_length"),
        )
        for i, c in enumerate(columns)
    ]))
    return one.select(rows.alias("r")).select(F.lit(table_name).alias("table_name"), "r.*")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram: (bin, bin_start, bin_end, count); the maximum falls into the last bin.

    The range is one global aggregate (two numbers, read back as literals); the counts are a second,
    partially aggregated pass."""
    v = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    rng = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if rng is None or rng["lo"] is None:
        return local_frame(df.sparkSession, [], "bin long, bin_start double, bin_end double, count long")
    lo, hi = float(rng["lo"]), float(rng["hi"])
    width = hi - lo
    b = (F.lit(1).cast("long") if width == 0 else
         F.least(F.floor(F.lit(float(bins)) * (F.col("v") - F.lit(lo)) / F.lit(width)).cast("long") + 1, F.lit(bins)))
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width) / bins).alias("bin_start"),
        (F.lit(lo) + F.col("bin") * F.lit(width) / bins).alias("bin_end"),
        "count",
    )
