"""Thin command line over the operators.

    python -m scholia.cli find-quotations --pages P --verses V --out O
    python -m scholia.cli detect-languages --pages P --train T --out O
    python -m scholia.cli retry --jobs J --results R ... --out O
    python -m scholia.cli stats --items I --files F --jobs J

Inputs are Parquet tables; ``--pages`` needs ``item_id`` and ``text``
(and ``page_seq`` for language counts).  ``retry`` writes the kept jobs to
``O`` and the kept rows of each result table ``R`` to ``O-<name of R>``.
"""

from __future__ import annotations

import argparse

from .operators import jobs as J
from .operators import language as L
from .operators import quotations as Q
from .operators import stats as ST
from .session import get_spark


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="scholia")
    sub = ap.add_subparsers(dest="cmd", required=True)
    fq = sub.add_parser("find-quotations")
    fq.add_argument("--pages", required=True)
    fq.add_argument("--verses", required=True)
    fq.add_argument("--out", required=True)
    fq.add_argument("--tokens", type=float, default=5.0)
    fq.add_argument("--tfidf", type=float, default=1.0)
    fq.add_argument("--potential", default=None, help="also export potential matches (CSV) here")
    dl = sub.add_parser("detect-languages")
    dl.add_argument("--pages", required=True)
    dl.add_argument("--train", required=True, help="table with lang and text columns")
    dl.add_argument("--out", required=True)
    rt = sub.add_parser("retry")
    rt.add_argument("--jobs", required=True)
    rt.add_argument("--results", nargs="*", default=[], help="result tables with a job_id column")
    rt.add_argument("--out", required=True)
    stt = sub.add_parser("stats")
    stt.add_argument("--items")
    stt.add_argument("--files")
    stt.add_argument("--jobs")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.cmd == "find-quotations":
        params = Q.QuotationParams(min_tokens=a.tokens, min_tfidf=a.tfidf).validate()
        corpus = Q.ReferenceCorpus.build(spark.read.parquet(a.verses), params)
        pages = spark.read.parquet(a.pages)
        if a.potential:
            Q.export_potential(Q.potential_matches(pages, corpus, ["item_id", "page_seq"] if "page_seq" in pages.columns else ["item_id"]), a.potential)
        Q.save_quotations(Q.find_quotations(pages, corpus), a.out)
    elif a.cmd == "detect-languages":
        prof = L.Profiles.build(L.train_profiles(spark.read.parquet(a.train)))
        pages = spark.read.parquet(a.pages)
        keys = ["item_id", "page_seq"] if "page_seq" in pages.columns else ["item_id"]
        L.save_language_counts(L.language_counts(L.sentence_languages(pages, prof, keys)), a.out)
    elif a.cmd == "retry":
        kept, results = J.retry_jobs(spark.read.parquet(a.jobs), [spark.read.parquet(r) for r in a.results])
        # Results first: a job that is gone while its rows remain would get them back when it is made again.
        for path, rows in zip(a.results, results):
            rows.write.mode("overwrite").parquet(f"{a.out}-{path.rstrip('/').split('/')[-1]}")
        kept.write.mode("overwrite").parquet(a.out)
    elif a.cmd == "stats":
        if a.files:
            ST.count_mimetypes(spark.read.parquet(a.files)).show(100, truncate=False)
        if a.items:
            ST.items_status(spark.read.parquet(a.items)).show(truncate=False)
        if a.jobs:
            ST.job_status(spark.read.parquet(a.jobs)).show(100, truncate=False)


if __name__ == "__main__":
    main()
