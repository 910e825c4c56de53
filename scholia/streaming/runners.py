"""Structured Streaming forms of the continuous services.

Each runner reads landed files with a file source (explicit schema), runs
the batch operators inside ``foreachBatch`` and commits through the
streaming checkpoint, so a restarted query resumes where it stopped and
an epoch replayed after a failure writes nothing twice (pages are taken once
by keyed state, each epoch overwrites its own folder; see ``keyed.py``).
Pages of one item may land at any time: results are stored per page, and
``language_results`` / ``quotation_results`` add them up per item.

``trigger_once=True`` uses ``availableNow`` (process what has landed, then
stop); otherwise a processing-time trigger polls like the services do.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import is_uuid, uuid_of
from ..operators import items as I
from ..operators import language as LG
from ..operators import quotations as Q
from ..sources import readers as RD
from ..sources import schemas as SC
from .keyed import process_once


def _trigger(writer, trigger_once: bool, interval: str):
    return writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime=interval)


def epoch_folder(root: str, checkpoint: str, epoch: int) -> str:
    """The folder of one epoch of the stream with this checkpoint.  A replayed
    epoch overwrites its own rows; a stream with another checkpoint counts
    its epochs from 0 in a folder of its own."""
    return f"{root}/stream={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}/epoch={epoch}"


def run(query) -> None:
    """Wait for an availableNow query to finish and surface its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


# --- T1: continuous ingest of item records ---------------------------------------

ITEM_TABLES = ("resources", "files", "items")


def ingest_items(spark: SparkSession, landing: str, table: str, checkpoint: str,
                 now=None, trigger_once: bool = True, interval: str = "15 minutes",
                 rejects: str | None = None, files_per_batch: int = 1000):
    """Landed item record files (one JSON record per line) -> change rows of
    items, resources and files below ``table``; ``current_items`` reads the
    tables as they stand.

    A micro-batch only adds its own rows, each stamped with ``_at`` (the
    file's modification time, its path, and the place in the file), so
    nothing that was written before is read or rewritten.  Items are written
    last: children of a version count only once its item row is there.
    Lines that are no item record are kept in ``rejects`` (next to the
    checkpoint by default)."""
    rejects = rejects or f"{checkpoint}-rejects"
    src = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(landing) \
        .select("value", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_path"),
                F.col("_metadata.file_block_start").alias("_block"))

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.withColumn("_at", F.struct("_time", "_path", "_block", F.monotonically_increasing_id().alias("line")))
        recs = (df.withColumnRenamed("value", "api").filter(F.trim("api") != "")
                .withColumn("record", F.from_json("api", SC.ITEM_RECORD))
                .withColumn("id", F.col("record.item.id"))).persist()
        bad = recs.filter(F.col("id").isNull()).select(F.col("api").alias("record"), F.col("_at._path").alias("file"))
        bad.write.mode("overwrite").parquet(epoch_folder(rejects, checkpoint, epoch))
        good = recs.filter(F.col("id").isNotNull())
        children = good.select("id", "_at", "record.resources")
        rows = {"resources": I.shred_resources(children, keep=["_at"]), "files": I.shred_files(children, keep=["_at"]),
                "items": RD.item_rows(good, now if now is not None else F.current_timestamp(), keep=["_at"])}
        for name in ITEM_TABLES:
            rows[name].write.mode("overwrite").parquet(epoch_folder(f"{table}/{name}", checkpoint, epoch))
        recs.unpersist()

    return _trigger(src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint),
                    trigger_once, interval).start()


def current_items(spark: SparkSession, table: str) -> dict[str, DataFrame]:
    """items, resources and files as they stand: the last version of each item
    and the children that came with it.  Write the result to a new folder
    now and then and start the next log there to keep reads short."""
    log = {name: spark.read.parquet(f"{table}/{name}").drop("stream", "epoch") for name in ITEM_TABLES}
    last = log["items"].groupBy("id").agg(F.max("_at").alias("_at"))
    # Two streams over the same files may both have written a version.
    out = {"items": log["items"].join(last, ["id", "_at"], "left_semi").dropDuplicates(["id", "_at"]).drop("_at")}
    of_last = last.withColumnRenamed("id", "item_id")
    for name, place in (("resources", ["resource_seq"]), ("files", I.PAGE_KEYS)):
        out[name] = log[name].join(of_last, ["item_id", "_at"], "left_semi") \
            .dropDuplicates(["item_id", "_at", *place]).drop("_at")
    return out


# --- T2/T3: full-text messages and dead letters ------------------------------------

def write_messages(df: DataFrame, path: str) -> None:
    """(job_id, item_id, full_text) -> JSON lines."""
    df.select("job_id", "item_id", "full_text").write.mode("append").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Streaming source of messages; unusable lines keep their text in
    ``_corrupt_record``."""
    return (spark.readStream.schema(SC.MESSAGE).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def split_dead_letters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good messages, dead letters(reason, key, record))."""
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))
              .when(F.col("item_id").isNull() | F.col("job_id").isNull(), F.lit("missing key"))
              .when(~is_uuid(F.col("job_id")), F.lit("bad job id")))
    tagged = df.withColumn("reason", reason)
    good = tagged.filter(F.col("reason").isNull()).select("job_id", "item_id", "full_text")
    dead = tagged.filter(F.col("reason").isNotNull()).select(
        "reason", F.coalesce("job_id", "_corrupt_record").alias("key"),
        F.coalesce("_corrupt_record", F.to_json(F.struct("job_id", "item_id", "full_text"))).alias("record"))
    return good, dead


def route_messages(spark: SparkSession, landing: str, good_path: str, dead_path: str, checkpoint: str,
                   trigger_once: bool = True, interval: str = "1 minute"):
    src = read_messages(spark, landing)

    def batch(df: DataFrame, epoch: int) -> None:
        # Each epoch owns one folder per sink and overwrites it, so an epoch
        # replayed after a failure replaces its own output instead of adding
        # to it (readers see ``stream`` and ``epoch`` as partition columns).
        df = df.persist()
        good, dead = split_dead_letters(df)
        good.write.mode("overwrite").parquet(epoch_folder(good_path, checkpoint, epoch))
        dead.write.mode("overwrite").parquet(epoch_folder(dead_path, checkpoint, epoch))
        df.unpersist()

    return _trigger(src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint),
                    trigger_once, interval).start()


# --- T5: continuous language detection ----------------------------------------------

def detect_languages(spark: SparkSession, landing: str, schema, profiles: LG.Profiles, results: str,
                     checkpoint: str, item: str = "item_id", page: str = "page_seq",
                     destination: str = "language", trigger_once: bool = True, interval: str = "15 minutes",
                     files_per_batch: int = 1000):
    """Landed page files -> sentence counts per page and language, appended
    once per (item, page); read them with ``language_results``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def detected(df: DataFrame) -> DataFrame:
        det = LG.sentence_languages(df, profiles, keys=[item, page])
        counts = det.groupBy(item, page, "lang").agg(F.count(F.lit(1)).cast("int").alias("sentences"))
        return counts.select(uuid_of(F.col(item), F.lit(destination)).alias("job_id"), item, page, "lang", "sentences")

    return process_once(src, [item, page], detected, results, checkpoint, trigger_once, interval)


def language_results(spark: SparkSession, results: str, item: str = "item_id", page: str = "page_seq") -> DataFrame:
    """(job_id, item, lang, sentences) over all pages that have landed so far."""
    rows = spark.read.parquet(results)
    # streams with other checkpoints may have taken a page too
    by_page = rows.groupBy("job_id", item, page, "lang").agg(F.max("sentences").alias("sentences"))
    return by_page.groupBy("job_id", item, "lang").agg(F.sum("sentences").cast("int").alias("sentences"))


# --- T6: continuous quotation detection ----------------------------------------------

def detect_quotations(spark: SparkSession, landing: str, schema, corpus: Q.ReferenceCorpus, results: str,
                      checkpoint: str, item: str = "item_id", page: str = "page_seq", trigger_once: bool = True,
                      interval: str = "15 minutes", files_per_batch: int = 1000):
    """Landed page files joined with the (static) reference corpus; quotations
    appended once per (item, page); read them with ``quotation_results``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    return process_once(src, [item, page], lambda df: Q.find_quotations(df, corpus, keys=[item, page]), results, checkpoint, trigger_once, interval)


def quotation_results(spark: SparkSession, results: str, corpus: Q.ReferenceCorpus, item: str = "item_id") -> DataFrame:
    """(job_id, item, reference_id, verse_id, probability): per reference the best page and version so far."""
    rows = spark.read.parquet(results).groupBy("job_id", item, "verse_id").agg(F.max("probability").alias("probability"))
    return Q.best_version(rows, ["job_id", item], corpus.params).select("job_id", item, "reference_id", "verse_id", "probability")
