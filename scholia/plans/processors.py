"""User processors over the page table (the extension point).

A processor is a name (its job destination) and a function
``f(pages) -> DataFrame`` where ``pages`` has ``job_id, item_id,
resource_seq, file_seq, format_seq, text`` and the result has ``job_id``
and ``item_id``.  :func:`run_processor` does the job bookkeeping around it:
create jobs for unqueued items, claim them, build page text, run ``f``,
and end every claimed job (finished / skipped / failed).  ``f`` is free to
use built-in functions, pandas UDFs, ``mapInPandas`` or Python UDTFs.

A page processor is a Python function of one page (``register_pages``).  What
it raises fails the page's job alone: :func:`run_page_processor` keeps the
error beside the rows, gives out no results of a failed job, and writes
results, errors and the jobs table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import items as I
from ..operators import jobs as J

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    """Decorator: ``@register('word_counts') def f(pages): ...``"""
    def deco(f):
        REGISTRY[name] = f
        return f
    return deco


@dataclass
class ProcessorRun:
    results: DataFrame
    jobs: DataFrame
    errors: DataFrame | None = None


def run_processor(name: str, items: DataFrame, jobs: DataFrame, files: DataFrame, now) -> ProcessorRun:
    """Run a registered processor once over its whole backlog."""
    f = REGISTRY[name]
    new = J.create_jobs(items, jobs, name)
    all_jobs = jobs.select(*J.JOB_COLUMNS).unionByName(new)
    claimed = all_jobs.filter((F.col("destination") == name) & (F.col("status") == "ready")) \
        .withColumn("status", F.lit("running")).withColumn("started", now)
    pages = J.job_pages(claimed, I.page_text(files), name)
    results = f(pages)
    outcomes = J.job_outcomes(claimed, items, pages.select("item_id").distinct())
    ended = J.end_jobs(claimed, outcomes, now)
    return ProcessorRun(results, J.apply_changes(all_jobs, ended))


#: name -> (function of a page's row as a dict, giving rows as dicts; their schema)
PAGE_REGISTRY: dict[str, tuple[Callable[[dict], list[dict]], str]] = {}


def register_pages(name: str, schema: str):
    """Decorator: ``@register_pages('n_lines', 'lines int') def f(page): return [{'lines': ...}]``"""
    def deco(f):
        PAGE_REGISTRY[name] = (f, schema)
        return f
    return deco


def run_page_processor(name: str, items: DataFrame, jobs: DataFrame, files: DataFrame, now, sink: str) -> ProcessorRun:
    """Run a page processor over its whole backlog; results, errors and jobs are written below ``sink``.

    A page's rows and errors are written first, in one pass, so the function
    runs once a page however many tables are read from them."""
    f, schema = PAGE_REGISTRY[name]
    names = [c.split()[0] for c in schema.split(",")]

    def guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch.to_dict("records"):
                key = (page["job_id"], page["item_id"])
                try:
                    out += [(*key, *[r.get(c) for c in names], None) for r in f(page)]
                except Exception as e:  # any error of the user's function is the job's, not the run's
                    out.append((*key, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["job_id", "item_id", *names, "error"])

    spark = items.sparkSession
    all_jobs = jobs.select(*J.JOB_COLUMNS).unionByName(J.create_jobs(items, jobs, name))
    claimed = all_jobs.filter((F.col("destination") == name) & (F.col("status") == "ready")) \
        .withColumn("status", F.lit("running")).withColumn("started", now)
    pages = J.job_pages(claimed, I.page_text(files), name)
    pages.mapInPandas(guarded, f"job_id string, item_id string, {schema}, error string").write.mode("overwrite").parquet(f"{sink}/pages")
    done = spark.read.parquet(f"{sink}/pages")
    errors = done.filter(F.col("error").isNotNull()).groupBy("job_id", "item_id").agg(F.min("error").alias("error"))
    errors.write.mode("overwrite").parquet(f"{sink}/errors")
    errors = spark.read.parquet(f"{sink}/errors")
    done.filter(F.col("error").isNull()).join(errors.select("job_id"), "job_id", "left_anti").drop("error") \
        .write.mode("overwrite").parquet(f"{sink}/results")
    # jobs without text are skipped, those without an item failed, as ever
    outcomes = J.job_outcomes(claimed, items, pages.select("item_id").distinct())
    outcomes = outcomes.join(errors.select(F.col("job_id").alias("id"), "error"), "id", "left") \
        .select("id", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.col("outcome")).alias("outcome"))
    J.apply_changes(all_jobs, J.end_jobs(claimed, outcomes, now)).write.mode("overwrite").parquet(f"{sink}/jobs")
    return ProcessorRun(spark.read.parquet(f"{sink}/results"), spark.read.parquet(f"{sink}/jobs"), errors)


@register("word_counts")
def word_counts(pages: DataFrame) -> DataFrame:
    """Example processor: words and pages per item."""
    return pages.groupBy("job_id", "item_id").agg(
        F.sum(F.size(word_tokens("text"))).alias("n_words"),
        F.count(F.lit(1)).alias("n_pages"))
