"""Deterministic text form of values and SHA-256 keys over it (row hash, surrogate keys).

The canonical text of a value is what the hash covers, so it is defined once, here:
strings as is, integers in decimal, timestamps as ``yyyy-MM-dd HH:mm:ss[.ffffff]`` (instants in UTC), dates as ``yyyy-MM-dd``,
booleans as ``True`` / ``False``, floating point in the shortest round-trip form with fixed notation for
1e-4 <= |x| < 1e16 (``10000000.0``, ``0.00025``) and ``1e+16`` / ``2.5e-06`` outside — the layout of
Python's ``str`` and of DuckDB (single precision: numpy's layout, positional below 1e6) (Spark's own cast writes ``1.0E7`` and, on some JVMs, 17 digits where 16
suffice), built with string functions. NULL and NaN
(a missing value to pandas) become the empty string (``concat_ws`` would silently skip a NULL and shift the
remaining fields).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

# Field separator and digest width of every key the engine produces.
SEPARATOR = "|"
DIGEST_BITS = 256


def _formatted_float_text(c: Column, single: bool) -> Column:
    """Shortest round-trip text of a finite, non-zero float/double, laid out as described above.

    The shortest digits are the first ``%.Ne`` rendering (15, 16, then 17 significant digits; 6 to 9 for
    single precision) that converts back to the same value — any value with a shorter exact form has it
    as the zero-padded prefix of its 15-digit rounding, so values of up to 15 significant digits are exact.
    For values that need 16-17 digits the JVM formatter rounds from its own digit string, so in rare ties
    the last digit can differ from a correctly rounded rendering.
    """
    kind = "float" if single else "double"
    x = c.cast("double")
    tries = (6, 7, 8, 9) if single else (15, 16, 17)
    chosen = F.format_string(f"%.{tries[-1] - 1}e", x)
    for p in reversed(tries[:-1]):
        cand = F.format_string(f"%.{p - 1}e", x)
        chosen = F.when(cand.try_cast(kind) == c, cand).otherwise(chosen)
    body = F.regexp_replace(chosen, "^-", "")
    sign = F.when(chosen.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    e = F.substring_index(body, "e", -1).cast("int")  # decimal exponent of the leading digit
    stripped = F.regexp_replace(F.regexp_replace(F.substring_index(body, "e", 1), r"\.", ""), "0+$", "")
    digits = F.when(stripped == "", F.lit("0")).otherwise(stripped)
    n = F.length(digits)
    fixed_big = F.concat(  # 1 <= |x| < 1e16
        F.rpad(F.substr(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."),
        F.when(n > e + 1, F.substr(digits, e + 2, n)).otherwise(F.lit("0")),
    )
    fixed_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)  # 1e-4 <= |x| < 1
    sci = F.concat(
        F.when(n > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2), n)))
        .otherwise(digits),
        F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"),
    )
    if single:  # numpy's float32 text: positional for 1e-4 <= |x| < 1e6 (by value)
        positional = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e6)
    else:  # Python's float text: positional when the leading digit's exponent is in [-4, 16)
        positional = (e >= -4) & (e < 16)
    text = F.concat(sign, F.when(positional, F.when(e >= 0, fixed_big).otherwise(fixed_small)).otherwise(sci))
    return text


def float_text(c: Column, single: bool = False) -> Column:
    """Shortest round-trip text of a float/double (see ``_formatted_float_text``); NaN -> NULL."""
    plain = c.cast("string")
    # Fast path: Spark's own text without exponent and with at most 15 digits in all (sign and point
    # aside) is already the shortest form (a decimal of <= 15 digits that converts back is unique). The JVM writes no
    # exponent from 1e-3 up to 1e7; both are told from the number, so that the text is made as seldom as possible.
    fast = (F.abs(c) >= 1e-3) & (F.abs(c) < (1e6 if single else 1e7)) & (F.length(plain) <= F.when(c < 0, 17).otherwise(16))
    # The formatted rendering reuses its pieces many times; inside a lambda it is evaluated only for the
    # rows that reach it instead of being hoisted in front of the CASE for every row.
    formatted = F.transform(F.array(c), lambda v: _formatted_float_text(v, single))[0]
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when(c == 0, F.when(plain.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
        .when(fast, plain)
        .otherwise(formatted)
    )


def canonical_text(col: Column | str, data_type: T.DataType | None = None) -> Column:
    """Text form of one value used inside hashes; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(data_type, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float_text(c, single=isinstance(data_type, T.FloatType))
    if isinstance(data_type, T.TimestampType):  # the UTC wall time, whatever the session's zone
        micros = F.unix_micros(c)
        text = F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("string")
        return F.when(micros % 1000000 == 0, text).otherwise(_six_digits(text))
    if isinstance(data_type, T.TimestampNTZType):
        return _six_digits(c.cast("string"))
    return c.cast("string")


def _six_digits(text: Column) -> Column:
    """Timestamp text whose fraction, if there is one, has six digits."""
    return F.when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("."),
                                               F.rpad(F.substring_index(text, ".", -1), 6, "0"))).otherwise(text)


def hash_columns(columns: Iterable[Column | str], types: Iterable[T.DataType | None] | None = None) -> Column:
    """SHA-256 hex over ``text(v1)|text(v2)|...`` with NULL as ''."""
    cols = list(columns)
    tps = list(types) if types is not None else [None] * len(cols)
    parts = [F.coalesce(canonical_text(c, t), F.lit("")) for c, t in zip(cols, tps)]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), DIGEST_BITS)


def hash_frame_columns(df, names: Iterable[str]) -> Column:
    """``hash_columns`` over named columns of ``df``, using their declared types."""
    names = list(names)
    types = {f.name: f.dataType for f in df.schema.fields}
    return hash_columns([F.col(f"`{n}`") for n in names], [types[n] for n in names])
