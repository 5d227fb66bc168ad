"""Print the physical plans of the plan-only queries (used to write PLANS.md).

usage: python tests/explain_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PLAN_ONLY = ["dedupe_keys", "dq_report", "merge_upsert", "aggregate_by_keys", "transform_chain", "dq_quarantine", "schema_profile"]


def main() -> None:
    from sluice.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or PLAN_ONLY
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = entry.queries()
    for n in names:
        print(f"### {n}\n\n```")
        print(qs[n](spark, sf)._jdf.queryExecution().executedPlan().toString().rstrip())
        print("```\n")


if __name__ == "__main__":
    main()
