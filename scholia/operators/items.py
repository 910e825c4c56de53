"""Item tables: shredding, assembly, backlog rules and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import blank_to_null, is_resource
from ..functions.markup import markup_to_text

RESOURCE_FIELDS = ["fulltext_file", "djvu_text_file", "image", "pdf", "url", "caption"]
FILE_FIELDS = ["mimetype", "fulltext", "fulltext_service", "word_coordinates", "url", "info", "use"]
PAGE_KEYS = ["resource_seq", "file_seq", "format_seq"]


def shred_resources(records: DataFrame, id_col: str = "id", keep: list[str] = ()) -> DataFrame:
    """Parsed item records -> resource rows (item_id, resource_seq, fields...).

    Blank strings become NULL.  ``records`` has ``id_col`` and ``resources``
    (array of structs, as in :data:`scholia.sources.schemas.ITEM_RECORD`);
    ``keep`` names extra input columns carried along.
    """
    r = records.select(F.col(id_col).alias("item_id"), *keep,
                       F.posexplode("resources").alias("resource_seq", "r"))
    return r.select("item_id", F.col("resource_seq").cast("int"),
                    *[blank_to_null(F.col(f"r.{f}")).alias(f) for f in RESOURCE_FIELDS], *keep)


def shred_files(records: DataFrame, id_col: str = "id", keep: list[str] = ()) -> DataFrame:
    """Parsed item records -> file rows keyed by (item, resource, file, format) seq."""
    r = records.select(F.col(id_col).alias("item_id"), *keep,
                       F.posexplode("resources").alias("resource_seq", "r"))
    f = r.select("item_id", *keep, "resource_seq", F.posexplode("r.files").alias("file_seq", "formats"))
    g = f.select("item_id", *keep, "resource_seq", "file_seq", F.posexplode("formats").alias("format_seq", "x"))
    return g.select("item_id", *[F.col(c).cast("int") for c in PAGE_KEYS],
                    *[blank_to_null(F.col(f"x.{c}")).alias(c) for c in FILE_FIELDS], *keep)


def item_summary(items: DataFrame, resources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, n_resources, n_files): the item's one-line description, by grouped counts."""
    nr = resources.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_resources"))
    nf = files.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_files"))
    return (items.select("id")
            .join(nr.withColumnRenamed("item_id", "id"), "id", "left")
            .join(nf.withColumnRenamed("item_id", "id"), "id", "left")
            .select("id", F.coalesce("n_resources", F.lit(0)).alias("n_resources"),
                    F.coalesce("n_files", F.lit(0)).alias("n_files")))


def assemble_items(items: DataFrame, resources: DataFrame, files: DataFrame) -> DataFrame:
    """One nested record per item: item columns + sorted resources[] + files[]."""
    rs = resources.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("resource_seq", *RESOURCE_FIELDS))).alias("resources"))
    fs = files.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct(*PAGE_KEYS, *FILE_FIELDS))).alias("files"))
    return (items.join(rs.withColumnRenamed("item_id", "id"), "id", "left")
            .join(fs.withColumnRenamed("item_id", "id"), "id", "left"))


def unfetched(items: DataFrame) -> DataFrame:
    """Items whose record was never fetched (api IS NULL), newest first."""
    return items.filter(F.col("api").isNull()).orderBy(F.desc("updated"), "id")


def fetched(items: DataFrame) -> DataFrame:
    return items.filter(F.col("api").isNotNull())


def fetch_backlog(items: DataFrame, failures: DataFrame, now, cooldown_minutes: int = 60) -> DataFrame:
    """Unfetched items worth fetching now: not a resource URL and not failed
    within the cool-down.  ``now`` is a Column or timestamp literal."""
    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    cutoff = now_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cooldown_minutes))
    u = items.filter(F.col("api").isNull() & ~is_resource(F.col("url")))
    j = u.join(failures.select(F.col("item_id").alias("id"), "failed_at"), "id", "left")
    return j.filter(F.col("failed_at").isNull() | (F.col("failed_at") <= cutoff)).drop("failed_at")


def backlog_gate(items: DataFrame, failures: DataFrame, now, cooldown_minutes: int = 60) -> DataFrame:
    """One row: n_unfetched, n_cooling and whether to work (n_cooling < n_unfetched)."""
    now_c = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    cutoff = now_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cooldown_minutes))
    # One aggregate over both inputs (no join needed for two scalars).
    u = items.select(F.col("api").isNull().cast("long").alias("u"), F.lit(0).cast("long").alias("c"))
    c = failures.select(F.lit(0).cast("long").alias("u"), (F.col("failed_at") > cutoff).cast("long").alias("c"))
    g = u.unionByName(c).agg(F.coalesce(F.sum("u"), F.lit(0)).alias("n_unfetched"),
                             F.coalesce(F.sum("c"), F.lit(0)).alias("n_cooling"))
    return g.withColumn("work", (F.col("n_unfetched") > 0) & (F.col("n_cooling") < F.col("n_unfetched")))


def page_text(files: DataFrame) -> DataFrame:
    """(item_id, resource_seq, file_seq, format_seq, text): the item's page text.

    All ``text/plain`` files with text; only for items without any, all
    ``text/xml`` files with markup removed.  Items with neither get no row.
    Done as a union and an anti-join (no per-item window), so one huge item
    does not pin one task.
    """
    has_text = F.col("fulltext").isNotNull()
    plain = files.filter((F.col("mimetype") == "text/plain") & has_text)
    xml = files.filter((F.col("mimetype") == "text/xml") & has_text)
    plain_items = plain.select("item_id").distinct()
    xml_only = xml.join(plain_items, "item_id", "left_anti")
    return (plain.select("item_id", *PAGE_KEYS, F.col("fulltext").alias("text"))
            .unionByName(xml_only.select("item_id", *PAGE_KEYS, markup_to_text(F.col("fulltext")).alias("text"))))


def number_pages(pages: DataFrame, item: str = "item_id") -> DataFrame:
    """Add a dense ``page_seq`` (0-based) in (resource, file, format) order."""
    w = Window.partitionBy(item).orderBy(*PAGE_KEYS)
    return pages.withColumn("page_seq", (F.row_number().over(w) - 1).cast("int"))


def items_with_text(files: DataFrame) -> DataFrame:
    """Distinct item ids that have page text."""
    ok = F.col("fulltext").isNotNull() & F.col("mimetype").isin("text/plain", "text/xml")
    return files.filter(ok).select("item_id").distinct()


def array_search(df: DataFrame, column: str, terms: list[str], mode: str = "any") -> DataFrame:
    """Rows whose array column contains a term (``any``) or all terms (``all``)."""
    arr = F.array(*[F.lit(t) for t in terms])
    if mode == "any":
        return df.filter(F.arrays_overlap(F.col(column), arr))
    if mode == "all":
        return df.filter(F.size(F.array_except(arr, F.col(column))) == 0)
    raise ValueError("mode must be 'any' or 'all'")


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Inclusive range filter (pushes down to Parquet min/max statistics)."""
    return df.filter(F.col(column).between(low, high))


def backfill_languages(items: DataFrame) -> DataFrame:
    """Set ``languages`` from the stored record (``$.item.language``) where
    a record exists; other rows keep their value."""
    from ..functions.records import json_path
    langs = F.from_json(json_path(F.col("api"), "$.item.language"), "array<string>")
    return items.withColumn("languages", F.when(F.col("api").isNotNull(), langs).otherwise(F.col("languages")))


def backfill_updated(items: DataFrame, now) -> DataFrame:
    """Set ``updated`` to ``now`` on every row."""
    return items.withColumn("updated", now)


def page_manifest(collections: DataFrame, per_page: int = 1000) -> DataFrame:
    """(collection_id, page, url): one request URL per result page of every
    collection whose items URL belongs to the API (``count`` bounds the
    number of pages)."""
    from ..functions.records import collection_page_url, has_api
    c = collections.filter(has_api(F.col("items_url")))
    n = F.greatest(F.lit(1), F.ceil(F.col("count") / F.lit(per_page)).cast("int"))
    pages = c.select("id", "items_url", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return pages.select(F.col("id").alias("collection_id"), "page",
                        collection_page_url(F.col("items_url"), F.col("page"), per_page).alias("url"))


def item_manifest(items: DataFrame) -> DataFrame:
    """(id, fetch_url) for every item worth fetching (pass a backlog)."""
    from ..functions.records import item_fetch_url
    return items.filter(~is_resource(F.col("url"))).select("id", item_fetch_url(F.col("url")).alias("fetch_url"))
