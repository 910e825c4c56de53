"""Write the physical plan trees of the headline queries to PLANS.md.

usage: python tools/plans.py [sf_dir]
"""
import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scholia.plans.catalog import QUERIES  # noqa: E402
from scholia.session import get_spark  # noqa: E402

NAMES = ["find_quotations", "page_quotations_to_item", "sentence_languages", "multilingual_items", "page_text",
         "create_jobs", "end_jobs", "upsert_items", "items_status", "backlog_gate", "fk_audit"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n(1)")[0]
    scans = [ln for ln in text.splitlines() if ln.startswith("ReadSchema") or ln.startswith("PushedFilters")]
    return head.rstrip() + "\n" + "\n".join(sorted(set(scans)))


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    out = ["# Physical plans", "",
           f"`explain('formatted')` trees of the headline queries on `{d}` (AQE on; final plans may coalesce",
           "partitions or switch join strategy at run time). Generated by `tools/plans.py`.", ""]
    for n in NAMES:
        out += [f"## {n}", "", "```", tree(QUERIES[n](spark, d)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
