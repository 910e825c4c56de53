"""Spark session and shared-folder helpers.

Everything that needs a place on disk (lineage cuts, streaming
checkpoints) goes under the folder the cluster names in
``spark.checkpoint.dir``.  A folder of our own is only chosen when that
setting is missing, which happens in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "scholia",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scholia-ckpt-")
    sc.setCheckpointDir(configured)
    # setCheckpointDir appends a per-application folder; use that one.
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, factor: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Deal out the rows in front of an operator that expands each of them many
    times (n-gram explodes) and then reduces what came from one row.

    With ``keys`` (which tell the rows apart) the rows are dealt by them: only
    the text moves, and the sums per key that follow need no exchange.
    Without, round-robin the rows over ``factor x`` the default parallelism when the
    input arrives in fewer partitions than the parallelism (e.g. a file with
    one huge row group); well-split inputs are then returned unchanged.

    Session setting ``scholia.spreadInputs``: ``auto`` (default) looks at the
    input's partition count, which is free for file scans but runs upstream
    stages for an input that already contains a shuffle -- use ``never`` or
    ``always`` for such inputs.
    """
    spark = df.sparkSession
    mode = spark.conf.get("scholia.spreadInputs", "auto")
    parallelism = spark.sparkContext.defaultParallelism
    if mode == "never" or df.isStreaming:
        return df
    if keys:
        return df.repartition(max(parallelism * factor, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    if mode == "always" or df.rdd.getNumPartitions() < parallelism:
        return df.repartition(parallelism * factor)
    return df
