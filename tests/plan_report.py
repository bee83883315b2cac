"""Summarise the physical plan of every registered query (final AQE plans).

    python tests/plan_report.py /root/testdata/sf0.1 > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    joins = re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin)[^\n]*?(LeftOuter|Inner|LeftAnti|LeftSemi)", plan)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(sorted({f"{a.replace('HashJoin', 'HJ').replace('SortMergeJoin', 'SMJ')} {b}" for a, b in joins})) or "—",
        "pushed": sum(1 for p in pushed if p.strip()),
        "topk": ", ".join(x for x in ("TakeOrderedAndProject", "WindowGroupLimit") if x in plan) or "—",
        "skew": "yes" if "isSkewJoin=true" in plan else "",
    }


def main(sf_dir: str) -> None:
    from tillscope.plans import reports
    from tillscope.session import local_session

    spark = local_session(extra={"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "16"})
    print(f"# Physical plans at {os.path.basename(sf_dir)}\n")
    print("Final adaptive plans of every registered query (`tests/plan_report.py`). Shuffles count hash, range and")
    print("single-partition exchanges; broadcasts count broadcast exchanges; pushed = scans with pushed filters.\n")
    print("| Query | Shuffles | Broadcasts | Joins | Scans with pushed filters | Top-k |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, q in reports.QUERIES.items():
        df = q(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['pushed']} | {s['topk']} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
