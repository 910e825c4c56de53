"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the keys that are dealt over several tasks: 100,000 narrow rows, a few MB, are broadcast.
HOT_KEYS = 100_000


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; no task gets much more than ``least`` rows of one key.

    Keys with more rows in ``left`` than ``least`` (and than its rows over
    HOT_KEYS, so that there are at most HOT_KEYS of them) are dealt over as
    many places as they have such portions; ``right``, which should have few
    rows a key, is copied to each.  ``left`` should be a stored table: its
    keys are counted first, each task adding up its own, unless ``counts``
    (key, n) is given.  ``how``: inner or left.
    """
    counts = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.filter(F.col(key).isNotNull()).agg(F.sum("n"), F.max("n")).first()
    portion = max(least, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= portion:
        return left.join(right, key, how)
    found = counts.filter((F.col("n") > portion) & F.col(key).isNotNull()).select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / portion).cast("int").alias("places")).collect()
    hot = left.sparkSession.createDataFrame(found, f"hot_key {dict(left.dtypes)[key]}, places int")  # at most HOT_KEYS rows

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), df[key] == hot["hot_key"], "left").drop("hot_key").withColumn("places", F.coalesce("places", F.lit(1)))

    dealt = marked(left).withColumn("place", F.pmod(F.monotonically_increasing_id(), F.col("places")).cast("int")).drop("places")
    copied = marked(right).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    return dealt.join(copied, [key, "place"], how).drop("place")
