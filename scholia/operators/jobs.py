"""Job bookkeeping as table operators.

The jobs table has one row per (item, destination): ``id, item_id,
destination, started, finished, status``.  Every operator returns a new
DataFrame; :mod:`scholia.operators.tables` publishes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import uuid_of
from .tables import upsert

JOB_COLUMNS = ["id", "item_id", "destination", "started", "finished", "status"]


def _ts(now):
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def unqueued_items(items: DataFrame, jobs: DataFrame, destination: str) -> DataFrame:
    """Fetched items without a job for ``destination`` (NOT EXISTS -> anti join)."""
    j = jobs.filter(F.col("destination") == destination).select(F.col("item_id").alias("id"))
    return items.filter(F.col("api").isNotNull()).join(j, "id", "left_anti")


def queued_items(items: DataFrame, jobs: DataFrame, destination: str) -> DataFrame:
    j = jobs.filter(F.col("destination") == destination).select(F.col("item_id").alias("id"))
    return items.join(j, "id", "left_semi")


def create_jobs(items: DataFrame, jobs: DataFrame, destination: str) -> DataFrame:
    """New ``ready`` rows for every unqueued item (whole backlog at once).

    Ids are md5-shaped uuids of (item, destination), so a re-run of the same
    plan (or a lost task) produces the same ids; at most one job per
    (item, destination) is guaranteed by the anti-join and the distinct.
    """
    todo = unqueued_items(items, jobs, destination).select(F.col("id").alias("item_id")).distinct()
    return todo.select(uuid_of(F.col("item_id"), F.lit(destination)).alias("id"), "item_id",
                       F.lit(destination).alias("destination"),
                       F.lit(None).cast("timestamp").alias("started"),
                       F.lit(None).cast("timestamp").alias("finished"),
                       F.lit("ready").alias("status"))


def ready_jobs(jobs: DataFrame, destination: str) -> DataFrame:
    return jobs.filter((F.col("status") == "ready") & (F.col("destination") == destination))


def claim_jobs(jobs: DataFrame, destination: str, n: int, now) -> DataFrame:
    """The first ``n`` ready jobs (by id) of a destination, set running at ``now``."""
    first = ready_jobs(jobs, destination).orderBy("id").limit(n)
    return first.select("id", "item_id", "destination", _ts(now).alias("started"),
                        F.lit(None).cast("timestamp").alias("finished"), F.lit("running").alias("status"))


def apply_changes(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert changed job rows into the jobs table by id."""
    return upsert(jobs.select(*JOB_COLUMNS), changed.select(*JOB_COLUMNS), ["id"])


def job_outcomes(jobs: DataFrame, items: DataFrame, text_items: DataFrame) -> DataFrame:
    """(id, outcome): item missing -> failed; no page text -> skipped; else finished."""
    it = items.select(F.col("id").alias("item_id"), F.lit(True).alias("_item"))
    tx = text_items.select("item_id", F.lit(True).alias("_text"))
    j = jobs.select("id", "item_id").join(it, "item_id", "left").join(tx, "item_id", "left")
    outcome = (F.when(F.col("_item").isNull(), "failed")
               .when(F.col("_text").isNull(), "skipped").otherwise("finished"))
    return j.select("id", outcome.alias("outcome"))


def end_jobs(jobs: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Set status from ``outcomes(id, outcome)`` and finished = now; others unchanged.

    Any of skipped / failed / finished may follow any state (no guard, as
    in the reference); the finish time is set by all three.
    """
    o = outcomes.filter(F.col("outcome").isin("skipped", "failed", "finished"))
    j = jobs.join(o, "id", "left")
    return j.select("id", "item_id", "destination", "started",
                    F.when(F.col("outcome").isNotNull(), _ts(now)).otherwise(F.col("finished")).alias("finished"),
                    F.coalesce(F.col("outcome"), F.col("status")).alias("status"))


def job_lists(jobs: DataFrame) -> DataFrame:
    """(id, item_id, destination, list): skipped / in progress / finished lists."""
    lst = (F.when(F.col("status") == "skipped", "skipped")
           .when(F.col("started").isNotNull() & F.col("finished").isNull(), "in progress")
           .when(F.col("finished").isNotNull() & (F.col("status") == "finished"), "finished"))
    return jobs.select("id", "item_id", "destination", lst.alias("list")).filter(F.col("list").isNotNull())


def job_pages(jobs: DataFrame, pages: DataFrame, destination: str, statuses=("running",)) -> DataFrame:
    """(job_id, item_id, page keys..., text) for jobs of a destination with page text."""
    j = jobs.filter((F.col("destination") == destination) & F.col("status").isin(*statuses)) \
        .select(F.col("id").alias("job_id"), "item_id")
    return j.join(pages, "item_id")


def skipped_jobs(jobs: DataFrame, pages: DataFrame, destination: str, statuses=("running",)) -> DataFrame:
    """Jobs of a destination whose item has no page text."""
    j = jobs.filter((F.col("destination") == destination) & F.col("status").isin(*statuses))
    return j.join(pages.select("item_id").distinct(), "item_id", "left_anti")


def retry_jobs(jobs: DataFrame, results: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Drop skipped and failed jobs, and the result rows that point at them."""
    dropped = jobs.filter(F.col("status").isin("skipped", "failed")).select(F.col("id").alias("job_id"))
    kept = jobs.filter(~F.col("status").isin("skipped", "failed") | F.col("status").isNull())
    return kept, [r.join(dropped, "job_id", "left_anti") for r in results]

