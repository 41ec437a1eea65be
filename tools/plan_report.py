"""Write PLANS.md: the physical-plan shape of every registered query.

Usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)
For each query: columns read, pushed filters, shuffles, windows, join kinds,
and a flag for any cartesian product, nested-loop join, Python or Arrow function, cached
scan or exchange to a single partition.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave import catalog  # noqa: E402
from logweave.session import local_session  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInArrow", "FlatMapGroupsInArrow", "InMemoryTableScan", "SinglePartition")


def summarize(plan: str) -> dict:
    reads = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
    pushed = sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p))
    return {
        "reads": "; ".join(r.replace(",", ", ") for r in reads) or "(checkpoint / cached input)",
        "pushed": "; ".join(pushed) or "—",
        "exchanges": plan.count("Exchange "),
        "windows": plan.count("Window ["),
        "joins": ", ".join(sorted({j for j in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if j in plan})) or "—",
        "flags": ", ".join(b for b in BAD if b in plan) or "none",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` at `{sf}` (AQE initial plans; materialized inputs show as scans of",
        "checkpoint data). Flags list cartesian products, nested-loop joins, Python and Arrow functions, cached scans and exchanges to one",
        "partition (final rows of a global aggregate, or a window over one row per partition or part).",
        "",
        "| Query | Columns read | Pushed filters | Exchanges | Windows | Joins | Flags |",
        "|---|---|---|---|---|---|---|",
    ]
    for name, fn in catalog.queries().items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        lines.append(
            f"| {name} | {s['reads'][:120]} | {s['pushed'][:80]} | {s['exchanges']} | {s['windows']} | {s['joins']} | {s['flags']} |"
        )
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main()
