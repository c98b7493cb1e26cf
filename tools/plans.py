"""Print a short physical-plan summary (exchanges, scans with ReadSchema, joins, windows, Python
nodes) for registered queries: python tools/plans.py [sf_dir] query ..."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from velado.plans import catalog  # noqa: E402
from velado.session import get_spark  # noqa: E402

KEYS = ("Exchange", "Scan", "BroadcastHashJoin", "SortMergeJoin", "Window", "HashAggregate", "Generate",
        "TakeOrdered", "PythonUDF", "ArrowEval", "BatchEvalPython", "MapInPandas")


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    qs = catalog.queries()
    for name in args or list(qs):
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        n = sum(plan.count(f"Exchange {k}") for k in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobin"))
        print(f"== {name}: {n} shuffle exchange(s)")
        for line in plan.split("\n"):
            if any(k in line for k in KEYS):
                print("   ", line.strip()[:160])
    spark.stop()


if __name__ == "__main__":
    main()
