"""Streams with keyed state: once-only processing, links of collections, and
the cool-down of failed items.

State is kept by Spark per key (RocksDB, below the stream's checkpoint), so a
micro-batch costs what has landed, not what was done before: no result table
is read.  Results go to one folder per epoch, so an epoch that is replayed
after a failure overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.records import is_resource
from ..sources import readers as RD
from ..sources import schemas as SC

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk as it grows."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def once_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key that the stream ever sees (first writer wins)."""
    return rows.dropDuplicates(keys)


def process_once(rows: DataFrame, keys: list[str], process: Callable[[DataFrame], DataFrame], results: str, checkpoint: str,
                 trigger_once: bool = True, interval: str = "15 minutes"):
    """Start a stream that processes the first row of each key and writes what
    ``process`` makes of a micro-batch to the epoch's folder below ``results``."""
    from .runners import _trigger, epoch_folder

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            process(df).write.mode("overwrite").parquet(epoch_folder(results, checkpoint, epoch))
        finally:
            df.unpersist()

    with rocksdb(rows.sparkSession):
        return _trigger(once_only(rows, keys).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint),
                        trigger_once, interval).start()


# --- T1: collections, their links and stub items --------------------------------------

COLLECTION_TABLES = ("collections", "items", "links")


def ingest_collections(spark: SparkSession, listings: str, pages: str, table: str, checkpoint: str, patience: str = "2 days",
                       trigger_once: bool = True, interval: str = "15 minutes", files_per_batch: int = 1000) -> list:
    """Landed collection listings (a JSON listing a line) and result pages
    (below ``collection_id=<id>/``) -> rows of collections, stub items and
    links below ``table``, each key written once.

    A link is written when both its page and its collection's listing have
    landed, in either order and at most ``patience`` apart (by the files'
    times); the state of older files is dropped.  A pair that a later crawl
    lists again is not written again.  Read with ``ingested``."""
    raw = spark.readStream.schema(SC.COLLECTIONS_LISTING).option("maxFilesPerTrigger", files_per_batch).json(listings)
    listed = RD.collection_rows(raw.select("results", F.col("_metadata.file_modification_time").alias("listed_at")), keep=["listed_at"]) \
        .withWatermark("listed_at", patience)
    raw = spark.readStream.schema(SC.COLLECTION_PAGE.add("collection_id", "string")).option("maxFilesPerTrigger", files_per_batch).json(pages)
    entries = RD.page_entries(raw.select("*", F.col("_metadata.file_modification_time").alias("paged_at")), keep=["paged_at"]) \
        .filter(F.col("item_id").isNotNull()).withWatermark("paged_at", patience)
    near = F.expr(f"paged_at >= listed_at - INTERVAL {patience} AND paged_at <= listed_at + INTERVAL {patience}")
    links = entries.join(listed.select(F.col("id").alias("listed_id"), "listed_at"), (F.col("collection_id") == F.col("listed_id")) & near) \
        .select("item_id", "collection_id")  # state after the join goes by the pair alone
    streams = {
        "collections": (listed, ["id"], lambda df: df.drop("listed_at")),
        "items": (entries, ["item_id"], lambda df: df.select(F.col("item_id").alias("id"), "url")),
        "links": (links, ["item_id", "collection_id"], lambda df: df),
    }
    return [process_once(rows, keys, process, f"{table}/{name}", f"{checkpoint}/{name}", trigger_once, interval)
            for name, (rows, keys, process) in streams.items()]


def ingested(spark: SparkSession, table: str) -> dict[str, DataFrame]:
    """The tables that ``ingest_collections`` has written so far."""
    return {name: spark.read.parquet(f"{table}/{name}").drop("stream", "epoch") for name in COLLECTION_TABLES}


# --- F4, J12: the backlog with its cool-down -------------------------------------------

BACKLOG = "id string, eligible boolean, at timestamp"


class CoolDown(StatefulProcessor):
    """Per item: whether it may be fetched, told again whenever that changes.

    Rows have ``kind`` (found, failed, fetched) and ``at``.  A failed item
    gets a timer for the end of its cool-down; when event time has passed it,
    the item is told eligible again, unless it failed later or was fetched.
    """

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "found boolean, fetched boolean, failed_ms long, told boolean")

    def _told(self, key, eligible: bool, at_ms: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "eligible": [eligible], "at": [pd.Timestamp(at_ms, unit="ms")]})

    def _settle(self, key, found, fetched, failed, told, now_ms: int):
        eligible = found and not fetched and (failed is None or failed + self.minutes * 60_000 <= now_ms)
        self.state.update((found, fetched, failed, eligible))
        if eligible != told:
            yield self._told(key, eligible, now_ms)

    def handleInputRows(self, key, rows, timerValues):
        found, fetched, failed, told = self.state.get() if self.state.exists() else (False, False, None, False)
        last = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            kinds, at = batch["kind"], batch["at"].astype("datetime64[ms]").astype("int64")
            found = bool(found or (kinds == "found").any())
            fetched = bool(fetched or (kinds == "fetched").any())
            if (kinds == "failed").any():
                failed = max(failed or 0, int(at[kinds == "failed"].max()))
        if failed is not None and found and not fetched:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if failed + self.minutes * 60_000 > last:
                self.handle.registerTimer(failed + self.minutes * 60_000)
        yield from self._settle(key, found, fetched, failed, told, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        found, fetched, failed, told = self.state.get()
        yield from self._settle(key, found, fetched, failed, told, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def watch_backlog(events: DataFrame, results: str, checkpoint: str, cooldown_minutes: int = 60, trigger_once: bool = True, interval: str = "1 minute"):
    """Stream of (id, url, kind, at) -> changes of what may be fetched, below ``results``; read with ``backlog``.

    ``kind``: found (an item without a record), failed (a fetch), fetched, or
    clock (no item: event time alone).  Event time follows ``at``; resource
    URLs are no items to fetch."""
    from .runners import _trigger, epoch_folder

    rows = events.filter((F.col("kind") != "found") | ~is_resource(F.col("url"))).withWatermark("at", "0 seconds")
    changes = rows.groupBy("id").transformWithStateInPandas(CoolDown(cooldown_minutes), outputStructType=BACKLOG, outputMode="Append", timeMode="EventTime")

    def batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(epoch_folder(results, checkpoint, epoch))

    with rocksdb(events.sparkSession):
        return _trigger(changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), trigger_once, interval).start()


def backlog(spark: SparkSession, results: str) -> DataFrame:
    """The ids that may be fetched now: those whose last change says so."""
    log = spark.read.parquet(results)
    last = log.groupBy("id").agg(F.max_by("eligible", F.struct("batch", "at")).alias("eligible"))
    return last.filter("eligible").select("id")
