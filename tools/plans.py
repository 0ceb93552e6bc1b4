"""Print the physical operator tree of registered queries (operators only,
plus scan metadata), for reviewing plan shape: pruning, pushdown, joins,
exchanges, top-k limits and Python stages.

Usage: python tools/plans.py [sf_dir] [name ...] > docs/PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCAN_KEYS = ("PushedFilters", "PartitionFilters", "ReadSchema")
SKIP = {"InputAdapter", "WholeStageCodegen", "ColumnarToRow"}


def _children(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _line(node) -> str:
    name = node.nodeName()
    if "Scan" in name:
        try:
            meta = node.metadata()
        except Exception:  # noqa: BLE001 - scans of persisted data have no metadata
            return name
        parts = []
        for k in SCAN_KEYS:
            if meta.contains(k):
                v = str(meta.apply(k))
                parts.append(f"{k}: {v if len(v) < 110 else v[:107] + '...'}")
        return f"{name} " + "; ".join(parts)
    if name.startswith("Exchange") or "Join" in name or "Aggregate" in name or "WindowGroupLimit" in name:
        s = node.simpleString(25)
        s = "".join(ch if ch.isprintable() else " " for ch in s)
        return s if len(s) < 140 else s[:137] + "..."
    return name


def walk(node, depth=0, out=None):
    out = [] if out is None else out
    name = node.nodeName()
    if name.split(" ")[0] in SKIP or name.startswith("WholeStageCodegen"):
        for c in _children(node):
            walk(c, depth, out)
        return out
    out.append("  " * depth + "- " + _line(node))
    for c in _children(node):
        walk(c, depth + 1, out)
    return out


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    from nearfield.plans.registry import all_queries
    from nearfield.session import local_session

    spark = local_session(8, 8)
    qs = all_queries()
    print(f"# Physical plans ({sf}, initial adaptive plans)\n")
    for name in names or qs:
        df = qs[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan()
        print(f"## {name}\n\n```")
        print("\n".join(walk(plan)))
        print("```\n")


if __name__ == "__main__":
    main()
