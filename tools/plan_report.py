"""Summarise the final (adaptive) physical plan of every registered query.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

MARKS = [("scans", r"FileScan (parquet|binaryFile)|Scan (binaryFile|text)"), ("exchanges", r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|\bExchange RoundRobin"),
         ("reused", r"ReusedExchange"), ("broadcasts", r"BroadcastExchange"), ("group limits", r"WindowGroupLimit .*Partial"),
         ("windows", r"\bWindow \["), ("python", r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"),
         ("sort-merge joins", r"SortMergeJoin"), ("hash joins", r"BroadcastHashJoin|ShuffledHashJoin"),
         ("nested-loop joins", r"BroadcastNestedLoopJoin|CartesianProduct")]


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    from reelspark.session import get_session
    from reelspark.plans import QUERIES
    spark = get_session("local[8]", shuffle_partitions=16)
    print(f"# Plan shapes\n\nFinal adaptive plans at `{sf_dir}` (local[8], 16 shuffle partitions), counted by "
          "`tools/plan_report.py`.  `reused` counts shuffles or broadcasts that Spark reused instead of "
          "recomputing; `group limits` are partial WindowGroupLimits (top-k before the shuffle).\n")
    print("| query | " + " | ".join(m for m, _ in MARKS) + " |")
    print("| --- |" + " --- |" * len(MARKS))
    for name in sorted(QUERIES):
        qe = QUERIES[name](spark, sf_dir)._jdf.queryExecution()
        qe.toRdd().count()  # executes this very plan (no rows to the driver), so AQE finalises it
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        counts = [len(re.findall(rx, plan)) for _, rx in MARKS]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")


if __name__ == "__main__":
    main(sys.argv[1:])
