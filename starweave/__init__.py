"""starweave: profile wide tables, infer a dimensional model, split, check and load it — on Spark.

Every heavy step is a DataFrame plan (scans, aggregates, joins, windows) that Catalyst optimises; only
metadata-sized results (one row per column, per table or per check) ever reach the driver.
"""

from starweave.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
