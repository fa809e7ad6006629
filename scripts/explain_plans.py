"""Print a condensed physical plan for named queries (operators, scans, joins).

Usage: python scripts/explain_plans.py [sf_dir] name ...
For each query: exchanges, join strategies, windows, and every scan's
ReadSchema / PushedFilters, taken from ``explain("formatted")`` after AQE.
"""
import io
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from textprov.plans.catalog import queries  # noqa: E402
from textprov.session import build_session  # noqa: E402


def summarize(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    ops = re.findall(r"^\(\d+\) ([A-Za-z]+)", plan, re.M)
    counts = {}
    for o in ops:
        counts[o] = counts.get(o, 0) + 1
    keep = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
            "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "HashAggregate", "ObjectHashAggregate",
            "SortAggregate", "TakeOrderedAndProject", "Generate", "MapInPandas", "ArrowEvalPython", "Scan"]
    out = [", ".join(f"{k}={counts[k]}" for k in keep if k in counts)]
    for m in re.finditer(r"^\(\d+\) Scan (\w+).*?\nOutput.*?\n(?:.*\n)*?ReadSchema: (.*)", plan, re.M):
        pass
    scans = re.findall(r"Location: .*?\[(?:file:)?([^\]]*)\][^\n]*\n(?:PartitionFilters: [^\n]*\n)?(?:PushedFilters: ([^\n]*)\n)?ReadSchema: ([^\n]*)", plan)
    seen = set()
    for loc, pushed, schema in scans:
        key = (loc.rsplit("/", 1)[-1], pushed, schema)
        if key in seen:
            continue
        seen.add(key)
        out.append(f"  scan {key[0]}: read {schema}" + (f"; pushed {pushed}" if pushed and pushed != "[]" else ""))
    return "\n".join(out)


def main():
    d = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = build_session(master="local[8]", shuffle_partitions=16)
    qs = queries()
    for n in names or list(qs):
        df = qs[n](spark, d)
        df.write.format("noop").mode("overwrite").save()  # run it so AQE shows the final plan
        print(f"## {n}\n{summarize(df)}\n")


if __name__ == "__main__":
    main()
