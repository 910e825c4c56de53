"""Status views and key/domain audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import JOB_STATUSES, is_uuid, status_rank


def count_mimetypes(files: DataFrame) -> DataFrame:
    """Files per mimetype (NULL kept as its own group), most first."""
    return (files.groupBy("mimetype").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_first("mimetype")))


def items_per_collection(collections: DataFrame, links: DataFrame) -> DataFrame:
    """(title, n_items, id); collections without items count 0."""
    per = links.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (collections.join(per, collections["id"] == per["collection_id"], "left")
            .select("title", F.coalesce("n_items", F.lit(0)).alias("n_items"), "id")
            .orderBy(F.desc("n_items"), "id"))


def items_status(items: DataFrame) -> DataFrame:
    """Three rows (total, fetched, unfetched items) from one pass over items."""
    agg = items.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("api").isNotNull()).alias("fetched"),
                    F.count_if(F.col("api").isNull()).alias("unfetched"))
    rows = agg.select(F.expr("stack(3, 'total items', total, 'fetched items', fetched, "
                             "'unfetched items', unfetched) AS (type, n)"))
    return rows.distinct().orderBy(F.desc("n"), "type")


def job_status(jobs: DataFrame) -> DataFrame:
    """Jobs per (destination, status), ordered by destination then enum order."""
    return (jobs.groupBy("destination", "status").agg(F.count(F.lit(1)).alias("num_jobs"))
            .orderBy("destination", status_rank("status")))


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """(table, rule, key, n) for keys that occur more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.lit(table).alias("table"), F.lit("duplicate key").alias("rule"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"))


def null_keys(df: DataFrame, columns: list[str], keys: list[str], table: str) -> DataFrame:
    """One row per (row, column) where a NOT NULL column is NULL."""
    out = None
    for c in columns:
        part = df.filter(F.col(c).isNull()).select(
            F.lit(table).alias("table"), F.lit(f"{c} is null").alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.lit(1).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def bad_status(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(*JOB_STATUSES) | F.col("status").isNull()).select(
        F.lit("jobs").alias("table"), F.lit("status outside enum").alias("rule"),
        F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def bad_uuid(df: DataFrame, column: str, table: str) -> DataFrame:
    return df.filter(~is_uuid(F.col(column)) | F.col(column).isNull()).select(
        F.lit(table).alias("table"), F.lit(f"{column} not a uuid").alias("rule"),
        F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key"), F.lit(1).cast("long").alias("n"))


def id_mismatch(items: DataFrame) -> DataFrame:
    """Fetched items whose stored record carries another id than the row."""
    rid = F.get_json_object("api", "$.item.id")
    return items.filter(F.col("api").isNotNull() & (rid != F.col("id"))).select(
        F.lit("items").alias("table"), F.lit("record id differs").alias("rule"),
        F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))


def audit(df: DataFrame, table: str, keys: list[list[str]] = (), checks: dict[str, tuple] = {}) -> DataFrame:
    """(table, rule, key, n) for all rules of one table, from one scan.

    ``keys``: sets of columns that must be unique, reported once a repeated
    key with its rows (nulls are equal).  ``checks``: rule -> (condition that is true for a bad
    row, key columns), reported once a bad row, n = 1.  A row is expanded
    only into its keys and the rules it breaks; counts are summed before the
    shuffle.  Parts of a key are joined by "|", null parts left out.
    """
    def text(columns):
        return F.array(*[F.col(c).cast("string") for c in columns])

    rules = [F.struct(F.lit("duplicate key").alias("rule"), F.lit(i).alias("part"), text(ks).alias("key"), F.lit(None).cast("long").alias("row"))
             for i, ks in enumerate(keys)]
    for rule, (bad, ks) in checks.items():
        rules.append(F.struct(F.when(bad, F.lit(rule)).alias("rule"), F.lit(-1).alias("part"), text(ks).alias("key"), F.col("_row").alias("row")))
    found = df.withColumn("_row", F.monotonically_increasing_id()) \
        .select(F.explode(F.filter(F.array(*rules), lambda s: s["rule"].isNotNull())).alias("s")).select("s.*")
    found = found.groupBy("rule", "part", "key", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR part < 0")
    return found.select(F.lit(table).alias("table"), "rule", F.concat_ws("|", "key").alias("key"), "n")


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str],
            table: str) -> DataFrame:
    """Foreign-key audit: child rows whose key, with no part null, has no parent row (anti-join)."""
    p = parent.select(*[F.col(pk).alias(ck) for ck, pk in zip(child_keys, parent_keys)])
    bad = child.dropna(how="any", subset=child_keys).join(p, child_keys, "left_anti")
    return bad.groupBy(*child_keys).agg(F.count(F.lit(1)).alias("_rows")).select(
        F.lit(table).alias("table"), F.lit("orphan").alias("rule"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in child_keys]).alias("key"), F.col("_rows").alias("n"))
