"""Nested records: a parent table plus one child table per array field, at every depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Expand struct columns into ``parent_child`` columns until none is left."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{s.name}`").alias(f"{f.name}{sep}{s.name}") for s in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def flatten_nested(df: DataFrame, key_columns: list[str], sep: str = "_", sk_name: str = "PARENT_SK"
                   ) -> dict[str, DataFrame]:
    """``{"parent": ..., "<array field>": ...}``.

    The parent keeps scalar and struct fields (structs flattened) plus ``PARENT_SK`` (SHA-256 of the key
    columns, like every surrogate key). Each array or map field, also inside structs and inside other children, becomes a
    child table named by its path (``orders_lines``) with ``PARENT_SK``, the key columns, the positions of the
    elements above it (``orders_pos``), its own ``pos`` and the flattened element; a map's elements are a key and
    a value. Empty and NULL arrays produce no child rows (``posexplode``). Every output is a narrow transform of
    the input: no shuffle.
    """
    from starweave.functions.hashing import hash_frame_columns

    out: dict[str, DataFrame] = {}
    many = (T.ArrayType, T.MapType)

    def visit(frame: DataFrame, name: str, ids: list[str], up: list[str]) -> None:
        flat = _flatten_structs(frame, sep)
        nested = [f for f in flat.schema.fields if isinstance(f.dataType, many)]
        out[name] = flat.drop(*[f.name for f in nested])
        for f in nested:
            child = f.name if f.name.startswith(f"{name}{sep}") or name == "parent" else f"{name}{sep}{f.name}"
            above = [F.col("pos").alias(f"{name}{sep}pos")] if name != "parent" else []
            kept = [F.col(f"`{c}`") for c in [*ids, *up]]
            if isinstance(f.dataType, T.MapType):
                parts = F.posexplode(F.col(f"`{f.name}`")).alias("pos", f"{f.name}{sep}key", f"{f.name}{sep}value")
            else:
                parts = F.posexplode(F.col(f"`{f.name}`")).alias("pos", f.name)
            names_up = [*up, *([f"{name}{sep}pos"] if name != "parent" else [])]
            visit(flat.select(*kept, *above, parts), child, ids, names_up)

    keyed = df.withColumn(sk_name, hash_frame_columns(df, key_columns))
    visit(keyed.select(F.col(sk_name), *[F.col(f"`{c}`") for c in df.columns]), "parent", [sk_name, *key_columns], [])
    return out
