"""Physical-plan summary of every registered query -> PLANS.md.

For each query: join strategies, number of shuffle exchanges, Python
(Arrow) evaluation nodes, and each parquet scan's pruned ReadSchema and
pushed filters.  Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans import catalog  # noqa: E402
from tessera.session import build_session  # noqa: E402

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
PY = ("ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "BatchEvalPython", "TransformWithState")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    print("# Physical plans\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}` (AQE initial plans; counts are per query, including fixture views).\n")
    print("| query | joins | shuffles | python nodes | scans (table: columns read; pushed filters) |")
    print("|---|---|---|---|---|")
    for name, fn in catalog.queries().items():  # the training-data queries run many jobs of their own
        try:
            plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} | | | |")
            continue
        joins = sorted({j for j in JOINS if j in plan})
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan))
        py = sorted({p for p in PY if p in plan})
        scans = []
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(\d+ paths\)\[[^\]]*/([a-z]+)\.parquet\]"
                             r".*?PushedFilters: \[([^\]]*)\]", plan):
            cols = ",".join(c.strip().split("#")[0] for c in m.group(1).split(","))
            pushed = m.group(3).strip()
            scans.append(f"{m.group(2)}: {cols}" + (f"; {pushed}" if pushed else ""))
        print(f"| {name} | {', '.join(joins) or '-'} | {shuffles} | {', '.join(py) or '-'} | "
              f"{'<br>'.join(sorted(set(scans))) or '-'} |")


if __name__ == "__main__":
    main()
