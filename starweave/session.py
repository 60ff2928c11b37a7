"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine assumes. AQE re-plans joins and coalesces partitions at run time and splits
# skewed join partitions; the session time zone pins timestamp <-> text conversions (hashes use it).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files of collected RDDs are removed once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Codec of the Parquet files that the library writes: keys and hashes are hexadecimal text, of which zstd takes off half.
CODEC = "zstd"
# Options for tables that are mostly such text. Its digits are random: zstd finds nothing there but the half that any level
# takes off, and the lowest level takes the least time for it.
HASH_TEXT = {"compression": CODEC, "parquet.compression.codec.zstd.level": "1"}


def get_session(master: str | None = None, app_name: str = "starweave", **conf: str) -> SparkSession:
    """Return the active session, or build one with the engine defaults (tests / local runs)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where the session leaves it unset a scratch folder is picked only for ``local[...]`` masters (tests, one
    machine); on a cluster a machine-local folder would be invisible to the other executors, so that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="starweave-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a fresh folder below the shared checkpoint folder and read back.

    The lineage ends there: later readers do not recompute it, and a lost executor loses nothing. The folders are
    kept until the application's checkpoint folder is cleared, like Spark's own checkpoints. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"starweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.options(**{"compression": CODEC, **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (they may not have it on their path)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="starweave-code-"), "starweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("starweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
