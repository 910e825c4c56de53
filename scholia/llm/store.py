"""Tables in the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Largest side, in rows, that ``join_small`` broadcasts (narrow rows of under 100 bytes: 20 MB).
BROADCAST_ROWS = 200_000


#: Rows of a batch between Spark and Python workers for tables of whole texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers in batches of at most BATCH_ROWS rows, from now on in this session.

    A batch is held several times: written and read by Spark, and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor never makes earlier stages run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if no such path exists; other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``small`` is broadcast only if a count proves it has at most ``rows`` rows."""
    if small.count() <= rows:
        small = F.broadcast(small)
    return left.join(small, on, how)
