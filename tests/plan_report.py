"""Summarize the executed (final adaptive) plans of the headline queries into PLANS.md.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "ReusedExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
       "WindowGroupLimit", "Window [", "HashAggregate", "ObjectHashAggregate", "SortAggregate",
       "TakeOrderedAndProject", "UnionLoop", "PythonUDF", "EvalPython"]


def summarize(plan: str) -> dict:
    if "== Final Plan ==" in plan:                    # adaptive plan: keep the final section only
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    counts = {op.rstrip(" ["): plan.count(op) for op in OPS}
    counts["WindowGroupLimit Partial"] = len(re.findall(r"WindowGroupLimit .*Partial", plan))
    scans = set()
    for line in plan.splitlines():
        m = re.search(r"FileScan parquet \[([^\]]*)\]", line)
        if not m:
            continue
        cols = re.sub(r"#\d+L?", "", m.group(1))
        t = re.search(r"/([\w.]+)\]?, PartitionFilters", line) or re.search(r"/([\w.]+)\]", line)
        pushed = re.search(r"PushedFilters: \[(.*?)(?:\], ReadSchema|$)", line)
        scans.add((cols, t.group(1) if t else "?", pushed.group(1) if pushed else ""))
    return {"ops": {k: v for k, v in counts.items() if v}, "scans": sorted(scans)}


def main(argv):
    from pricetide.plans.registry import QUERIES
    from pricetide.session import build_session

    import bench
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    print(f"# Executed plans of the headline queries ({os.path.basename(sf_dir)}, local[8], AQE on)\n")
    print("Operator counts of the final adaptive plan after execution, and each parquet scan's columns and"
          " pushed filters. Generated by `python tests/plan_report.py`.\n")
    for key in bench.HEADLINE:
        df = QUERIES[key](spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.executedPlan().executeCollect()
        s = summarize(qe.executedPlan().toString())
        print(f"## {key}\n")
        print(", ".join(f"{k}: {v}" for k, v in s["ops"].items()) + "\n")
        for cols, table, pushed in s["scans"]:
            print(f"- `{table}` reads [{cols}]" + (f"; pushed: {pushed}" if pushed else ""))
        print()


if __name__ == "__main__":
    main(sys.argv)
