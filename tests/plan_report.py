"""Render the physical plans of the headline queries (python tests/plan_report.py [sf_dir] > PLANS.md)."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from vectables.session import local_session, storage_root  # noqa: E402

NAMES = ["search_batch", "get_by_id", "retrieve_ids", "upsert_bulk", "apply_oplog", "health_transitions",
         "round_report", "filter_via_index", "ivf_search", "latency_cumulative"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    storage_root(spark)  # shared folder from the session; a temp one only in local mode
    q = E.queries()
    for name in NAMES:
        df = q[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"file:/[^\]\s,]*", "<path>", plan)
        plan = re.sub(r"#\d+L?", "", plan)
        print(f"### {name}\n\n```\n{plan.strip()}\n```\n")


if __name__ == "__main__":
    main()
