"""Print the formatted physical plans of the main operators on the test tables.

Usage: python tools/explain_plans.py [sf_dir]

What to look for: the fact is one projection over the input (no Exchange of its own); dimensions and the
frequency table aggregate partially before their Exchange; the top-k has a partial WindowGroupLimit before
its Exchange; the FK check de-duplicates keys before the anti join; scans show ReadSchema with only the
needed columns.
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

from starweave.operators import quality  # noqa: E402
from starweave.operators.profile import typed_frequencies  # noqa: E402
from entry_plans import modelled, profile_of  # noqa: E402
from starweave.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    m = modelled(spark, sf_dir)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    prof = profile_of(spark, sf_dir, ("documents",))
    plans = {
        "fact (FACT_MAIN)": m.tables["FACT_MAIN"],
        "dimension (DIM_CUSTOMER)": m.tables["DIM_CUSTOMER"],
        "frequency table (documents)": typed_frequencies(prof.tables),
        "top values (documents)": prof.top_value_keys(),
        "orphan keys (lineitem -> orders)": quality.orphan_keys(lineitem, orders, "l_orderkey", "o_orderkey"),
        "duplicate keys (lineitem)": quality.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"]),
    }
    for title, df in plans.items():
        print(f"===== {title}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
