"""Scan every registered query's physical plan for shapes that do not scale:
cartesian products, nested-loop joins, windows without a partition key,
single-partition exchanges. Usage: python tools/plan_audit.py [--sf DIR]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agentlake.plans.registry import load_all  # noqa: E402
from agentlake.session import build_session  # noqa: E402

PATTERNS = {
    "cartesian": re.compile(r"CartesianProduct"),
    "nested_loop": re.compile(r"BroadcastNestedLoopJoin"),
    "single_partition": re.compile(r"Exchange SinglePartition"),
}


def global_window(plan: str) -> bool:
    """A window fed by a single-partition exchange: it has no partition key, or a constant one."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            for below in lines[i + 1:i + 6]:
                if "Exchange" in below:
                    if "SinglePartition" in below:
                        return True
                    break
    return False


def shapes(plan: str) -> list[str]:
    hits = [name for name, p in PATTERNS.items() if p.search(plan)]
    return hits + ["global_window"] * global_window(plan)


def audit(spark, sf_dir):
    found = {}
    for k, q in sorted(load_all().items()):
        hits = shapes(q.build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
        if hits:
            found[k] = hits
    return found


if __name__ == "__main__":
    sf = sys.argv[sys.argv.index("--sf") + 1] if "--sf" in sys.argv else "/root/testdata/sf0.01"
    s = build_session("local[8]", shuffle_partitions=8)
    for k, v in audit(s, sf).items():
        print(k, v)
