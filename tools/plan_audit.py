"""Audit the physical plans of every registered query.

For each query: number of shuffle exchanges, broadcast exchanges, and
whether any Cartesian product or nested-loop join appears (there must be
none).  Prints a markdown table; exits non-zero on a forbidden operator.

usage: python tools/plan_audit.py [sf_dir]
"""
import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scholia.plans.catalog import QUERIES  # noqa: E402
from scholia.session import get_spark  # noqa: E402

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n(1)")[0]


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark("local[4]", shuffle_partitions=8)
    rows, bad = [], []
    for name, q in QUERIES.items():
        tree = plan_text(q(spark, d))
        shuffles = sum(1 for ln in tree.splitlines() if ln.strip().lstrip(":+- ").startswith("Exchange"))
        broadcasts = tree.count("BroadcastExchange")
        forbidden = [f for f in FORBIDDEN if f in tree]
        if forbidden:
            bad.append(name)
        rows.append(f"| {name} | {shuffles} | {broadcasts} | {', '.join(forbidden) or 'none'} |")
    print("| query | shuffle exchanges | broadcast exchanges | cartesian / nested-loop joins |")
    print("| --- | --- | --- | --- |")
    print("\n".join(rows))
    if bad:
        print("FORBIDDEN in:", ", ".join(bad))
        sys.exit(1)


if __name__ == "__main__":
    main()
