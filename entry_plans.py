"""Plans over the test tables: profiles, models and splits used by the registered queries."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from starweave.operators.keys import candidate_keys
from starweave.operators.model import Model, infer_model
from starweave.operators.profile import Profile, profile_tables
from starweave.operators.split import source_columns, split, with_order
from starweave.session import HASH_TEXT, written
from entry_wide import TABLES, load_tables, orders_wide, sales_wide

# Fixed value: the load timestamp stamped on rows by the registered queries (results must be repeatable).
FIXED_LOAD_TS = _dt.datetime(2024, 1, 1, 0, 0, 0)


@dataclass
class Modelled:
    source: DataFrame
    hashed: DataFrame  # the source with its row hashes and their order
    profile: Profile
    keys: DataFrame
    model: Model
    tables: dict[str, DataFrame]


def wide_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "orders_wide":
        return orders_wide(spark, sf_dir)
    if name == "sales_wide":
        return sales_wide(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile_of(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> Profile:
    """Profile of test tables; derived wide inputs (joins) are written once, since profiling reads them several times."""
    def prepared(n: str) -> DataFrame:
        df = wide_input(spark, sf_dir, n)
        if n in ("orders_wide", "sales_wide"):
            return written(df, n)
        return df
    return profile_tables(spark, {n: prepared(n) for n in names})


def catalogue_profile(spark: SparkSession, sf_dir: str) -> Profile:
    return profile_tables(spark, load_tables(spark, sf_dir, TABLES))


def modelled(spark: SparkSession, sf_dir: str, name: str = "orders_wide", order_by: str = "transaction_id",
             **model_options) -> Modelled:
    # The wide input is read by the profile, every dimension (twice) and the fact: it is written once, in order.
    hashed = written(with_order(wide_input(spark, sf_dir, name), order_by), name, **HASH_TEXT)
    src = source_columns(hashed)
    prof = profile_tables(spark, {name: src})
    keys = candidate_keys(prof)
    model = infer_model(prof, keys, name, **model_options)
    tables = split(hashed, model, name, order_by=order_by, load_ts=FIXED_LOAD_TS, cache_input=False)
    return Modelled(src, hashed, prof, keys, model, tables)
