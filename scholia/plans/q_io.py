"""Registered queries for sources, sinks and table changes.

Round trips write JSON/CSV derived from the driver's tables into a fresh
folder below the shared checkpoint folder and read it back with the
library's readers; their oracle computes the same rows straight from the
tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import items as I
from ..operators import quotations as Q
from ..operators import tables as TB
from ..sources import readers as RD
from ..sources import standins as S
from ..sources.standins import SQL as STANDIN
from ..sources.standins import with_ctes
from ..session import scratch_path
from . import quotation_sql as QS

PER_PAGE = 10
CONV_BASE = "https://x.example/conv/"


# --- item records from conversations -----------------------------------------------

def conversation_records(spark, d):
    """One item record (JSON text) per conversation; one resource per turn with
    a plain and an XML format of the turn, plus an image file on odd turns."""
    conv = S.table(spark, d, "conversations")
    url = F.concat(F.lit(CONV_BASE), F.col("conv_id").cast("string"), F.lit("/turn/"), F.col("turn").cast("string"))
    fmt = lambda m, t, u: F.struct(F.lit(m).alias("mimetype"), t.alias("fulltext"),
                                   F.lit("").alias("fulltext_service"), u.alias("url"), F.lit("").alias("info"))
    text_file = F.array(fmt("text/plain", F.col("text"), F.lit("")),
                        fmt("text/xml", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")), F.lit("")))
    image_file = F.array(fmt("image/jpeg", F.lit(None).cast("string"), F.concat(url, F.lit(".jpg"))))
    files = F.when(F.col("turn") % 2 == 1, F.array(text_file, image_file)).otherwise(F.array(text_file))
    res = F.struct(F.lit("").alias("fulltext_file"), url.alias("url"), F.col("role").alias("caption"),
                   files.alias("files"))
    per = conv.select("conv_id", F.struct(F.col("turn"), res.alias("r")).alias("t"))
    item = F.struct(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("id"),
                    F.concat(F.lit(CONV_BASE), F.col("conv_id").cast("string")).alias("url"),
                    F.date_add(F.lit("2000-01-01").cast("date"), F.col("conv_id").cast("int")).cast("string").alias("date"),
                    F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
                    F.array(F.lit("english")).alias("language"))
    rec = per.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rec.select(F.to_json(F.struct(item.alias("item"),
                                         F.transform("ts", lambda x: x["r"]).alias("resources"))).alias("value"))


def _landed_records(spark, d):
    path = scratch_path(spark, "item-records")
    conversation_records(spark, d).write.text(path)
    return RD.read_item_records(spark, path)


def shred_resources(spark, d):
    rec = _landed_records(spark, d).select("id", "record.resources")
    return I.shred_resources(rec).select("item_id", "resource_seq", "fulltext_file", "url", "caption")


def shred_files(spark, d):
    rec = _landed_records(spark, d).select("id", "record.resources")
    return I.shred_files(rec).select("item_id", *I.PAGE_KEYS, "mimetype", "fulltext", "url")


def assemble_items(spark, d):
    recs = _landed_records(spark, d)
    rec = recs.select("id", "record.resources")
    items = RD.item_rows(recs, F.current_timestamp())
    nested = I.assemble_items(items, I.shred_resources(rec), I.shred_files(rec))
    return nested.select("id", "title", "year", F.size("resources").alias("n_resources"),
                         F.size("files").alias("n_files"))


# --- listings and result pages ----------------------------------------------------

#: Paths of a stored collection record that json_round_trip reads back, one for each field it adds to a listing.
RECORD_PATHS = [f"$.{f}" for f in ("extract_timestamp", "shelf_id", "timestamp", "index", "digitized", "hassegments", "other_title[0].alt", "resources[0]", "item.date", "item.title")] \
    + [f"$.{f}[0]" for f in ("contributor", "dates", "group", "image_url", "language", "location", "number", "number_lccn", "number_source_modified", "original_format", "partof",
                             "subject_topic", *[f"item.{x}" for x in ("access_advisory", "contributors", "format", "language", "location", "medium", "notes", "repository", "subjects", "summary")])]


def _more_fields() -> list:
    """The fields of RECORD_PATHS, each with a value that names it and the collection."""
    def text(path):
        return F.concat(F.col("id"), F.lit(" " + path))

    lists = [p[2:-3] for p in RECORD_PATHS if p.endswith("[0]") and p != "$.resources[0]"]
    details = [text(f"item.{n}").alias(n) for n in ("date", "title")] + [F.array(text(p)).alias(p[5:]) for p in lists if p.startswith("item.")]
    return [*[text(n).alias(n) for n in ("extract_timestamp", "shelf_id", "timestamp")], (F.col("count") + 1).alias("index"),
            (F.col("count") > 0).alias("digitized"), (F.col("count") == 0).alias("hassegments"),
            F.array(F.struct(text("other_title").alias("alt"))).alias("other_title"), F.array(F.col("count")).alias("resources"),
            *[F.array(text(p)).alias(p) for p in lists if "." not in p], F.struct(*details).alias("item")]


def _record_sql() -> str:
    """SQL of the value that json_round_trip makes of a collection's record."""
    given = {"index": "(count + 1)", "digitized": "(count > 0)", "hassegments": "(count = 0)", "resources[0]": "count"}
    parts = [given.get(p[2:], "id || ' " + p[2:].split("[")[0] + "'") for p in RECORD_PATHS]
    return f"SELECT 'record' AS kind, id AS key, concat_ws('|', {', '.join(parts)}) AS value FROM collections"


def json_round_trip(spark, d):
    colls = S.collections(spark, d)
    desc = F.when(F.col("count") > 0, F.array(F.concat(F.col("title"), F.lit(" description")))) \
        .otherwise(F.array().cast("array<string>"))
    n_listing_pages = max(1, -(-colls.count() // 1000))
    listing = colls.select(F.struct(
        "id", "title", desc.alias("description"), "count",
        F.concat(F.lit(R.API_BASE + "/collections/"), F.col("id")).alias("url"),
        F.concat(F.lit(R.API_BASE + "/collections/"), F.col("id"), F.lit("/")).alias("items"),
        F.array(F.lit("history")).alias("subject"), *_more_fields()).alias("c"),
        F.pmod(F.xxhash64("id"), F.lit(n_listing_pages)).alias("page"))
    listing = listing.groupBy("page").agg(F.collect_list("c").alias("results")) \
        .select(F.to_json(F.struct("results")).alias("value"))
    lpath = scratch_path(spark, "listing")
    listing.write.text(lpath)

    links = S.items_in_collections(spark, d).join(
        colls.select(F.col("id").alias("collection_id"), "count"), "collection_id")
    n_pages = F.greatest(F.lit(1), F.ceil(F.col("count") / F.lit(PER_PAGE)).cast("int"))
    pages = links.withColumn("page", F.pmod(F.xxhash64("item_id"), n_pages) + 1) \
        .groupBy("collection_id", "page").agg(
            F.collect_list(F.struct(F.col("item_id").alias("id"),
                                    F.concat(F.lit(S.ITEM_BASE), F.col("item_id")).alias("url"))).alias("results"))
    pages = pages.select("collection_id", F.to_json(F.struct(
        F.concat(F.lit("Collection "), F.col("collection_id")).alias("title"),
        F.struct(F.col("page").alias("current")).alias("pagination"), "results")).alias("value"))
    ppath = scratch_path(spark, "collection-pages")
    pages.write.partitionBy("collection_id").text(ppath)

    got_c = RD.read_collections(spark, lpath, multiline=False)
    got_p = RD.read_collection_pages(spark, ppath)
    record = F.concat_ws("|", *[F.get_json_object("api", p) for p in RECORD_PATHS])
    return got_c.select(F.lit("collection").alias("kind"), F.col("id").alias("key"),
                        F.concat_ws("|", "title", "description", F.col("count").cast("string")).alias("value")) \
        .unionByName(got_c.select(F.lit("record").alias("kind"), F.col("id").alias("key"), record.alias("value"))) \
        .unionByName(got_p.select(F.lit("page_item").alias("kind"), F.col("collection_id").alias("key"),
                                  F.col("item_id").alias("value")))


# --- CSV hand-over files --------------------------------------------------------

def csv_round_trip(spark, d):
    docs = S.table(spark, d, "documents")
    batch = docs.select(R.uuid_of(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit("quotations"))
                        .alias("job_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    path = scratch_path(spark, "document-batch")
    RD.write_document_batch(batch, path)
    return RD.read_document_batch(spark, path)


def prediction_round_trip(spark, d):
    from .catalog import QUOTATION_PARAMS
    pages = S.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"), "text")
    found = Q.find_quotations(pages, Q.ReferenceCorpus.build(S.verses(spark, d), QUOTATION_PARAMS))
    path = scratch_path(spark, "predictions")
    RD.write_predictions(found, path)
    good, _bad = RD.read_predictions(spark, path)
    return good.withColumn("probability", F.round("probability", 6))


# --- table changes ---------------------------------------------------------------

def _stub_loads(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id")
    iid = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    url = F.concat(F.lit(S.ITEM_BASE), F.col("doc_id").cast("string"))
    load1 = docs.filter((F.col("doc_id") % 4).isin(0, 1)).select(
        iid.alias("id"), url.alias("url"), F.lit("load1").alias("src"))
    l2 = docs.filter((F.col("doc_id") % 4).isin(1, 2, 3))
    load2 = l2.select(iid.alias("id"), F.concat(url, F.lit("#a")).alias("url"), F.lit("load2").alias("src"),
                      F.lit(0).alias("seq")).unionByName(
        l2.select(iid.alias("id"), F.concat(url, F.lit("#b")).alias("url"), F.lit("load2").alias("src"),
                  F.lit(1).alias("seq")))
    return load1, load2


def insert_if_absent(spark, d):
    load1, load2 = _stub_loads(spark, d)
    return TB.insert_if_absent(load1, load2, ["id"], order=["seq"])


def upsert_items(spark, d):
    load1, load2 = _stub_loads(spark, d)
    return TB.upsert(load1, load2, ["id"], order=["seq"])


def replace_children(spark, d):
    files = S.files(spark, d)
    pages = S.table(spark, d, "pages").filter(F.col("page_id") % 4 == 0)
    iid = F.concat(F.lit("doc/"), F.col("page_id").cast("string"))
    incoming = pages.select(iid.alias("item_id"), F.lit(0).alias("resource_seq"), F.lit(0).alias("file_seq"),
                            F.lit(0).alias("format_seq"), F.lit("text/plain").alias("mimetype"),
                            F.concat(F.lit("replaced "), iid).alias("fulltext"))
    out = TB.replace_children(files, incoming)
    return out.select("item_id", *I.PAGE_KEYS, "mimetype", F.md5(F.coalesce("fulltext", F.lit(""))).alias("h"))


def cascade_delete(spark, d):
    items = S.items(spark, d)
    gone = items.filter(F.expr("try_cast(substring(id, 5) AS BIGINT) % 7 = 0")).select("id")
    out = TB.cascade_delete({"links": (S.items_in_collections(spark, d), "item_id"),
                             "files": (S.files(spark, d), "item_id")}, gone)
    return out["links"].select(F.lit("links").alias("tbl"), "item_id", F.col("collection_id").alias("detail")) \
        .unionByName(out["files"].select(F.lit("files").alias("tbl"), "item_id",
                                         F.coalesce("mimetype", F.lit("-")).alias("detail")))


def _land_books(books, path):
    """Records in three layouts by id: one a line, two on a line, and spread over lines."""
    js = books.select(F.col("lccn").cast("long").alias("n"), F.to_json(F.struct(*books.columns)).alias("j"))
    lines = js.filter("n % 3 = 0").select("j")
    pairs = js.filter("n % 3 = 1").groupBy((F.col("n") / 6).cast("long").alias("g")) \
        .agg(F.array_join(F.sort_array(F.collect_list("j")), "").alias("j")).select("j")
    over_lines = js.filter("n % 3 = 2").select(F.concat(
        F.lit("{\n  "), F.expr("substring(j, 2, length(j) - 2)"), F.lit("\n}")).alias("j"))
    lines.unionByName(pairs).unionByName(over_lines).write.text(path)


def import_books(spark, d):
    paths = []
    for load in (1, 2):
        b = S.book_records(spark, d, load).withColumn(
            "publication_date", F.from_json("publication_date", "array<string>"))
        p = scratch_path(spark, f"books-{load}")
        _land_books(b, p)
        paths.append(p)
    rows = []
    for p in paths:
        books, _rejects = RD.read_books(spark, p, pattern="*.txt")
        rows.append(RD.book_rows(books, F.current_timestamp(), keep=["_file", "_seq"]))
    # First writer wins: the first load is kept whole; within the second load
    # the first record per lccn (file, then line order) is the one inserted.
    existing = TB.first_per_key(rows[0], ["lccn"], ["_file", "_seq"]).drop("_file", "_seq")
    merged = TB.insert_if_absent(existing, rows[1], ["lccn"], order=["_file", "_seq"])
    return merged.select("lccn", "title", "year", F.array_join("lang", ",").alias("lang"))


QUERIES = {
    "shred_resources": shred_resources, "shred_files": shred_files, "assemble_items": assemble_items,
    "json_round_trip": json_round_trip, "csv_round_trip": csv_round_trip,
    "prediction_round_trip": prediction_round_trip, "insert_if_absent": insert_if_absent,
    "upsert_items": upsert_items, "replace_children": replace_children, "cascade_delete": cascade_delete,
    "import_books": import_books,
}


# ---------------------------------------------------------------------------
# SQL forms
# ---------------------------------------------------------------------------

_CONV_RES = f"""
  SELECT conv_id, turn, role, text,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS resource_seq,
         '{CONV_BASE}' || conv_id || '/turn/' || turn AS url
  FROM conversations"""

_LOADS = f"""
  load1 AS (SELECT 'doc/' || doc_id AS id, '{S.ITEM_BASE}' || doc_id AS url, 'load1' AS src
            FROM documents WHERE doc_id % 4 IN (0, 1)),
  load2 AS (SELECT 'doc/' || doc_id AS id, '{S.ITEM_BASE}' || doc_id || '#a' AS url, 'load2' AS src, 0 AS seq
            FROM documents WHERE doc_id % 4 IN (1, 2, 3)
            UNION ALL
            SELECT 'doc/' || doc_id, '{S.ITEM_BASE}' || doc_id || '#b', 'load2', 1
            FROM documents WHERE doc_id % 4 IN (1, 2, 3))"""


def _book_year(c):
    found = f"regexp_extract({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0)"
    return f"CAST(coalesce(CASE WHEN {found} <> '' THEN TRY_CAST(substr({found}, 1, 4) AS INTEGER) END, 0) AS INTEGER)"


def sql() -> dict[str, str]:
    from .catalog import QUOTATION_PARAMS
    return {
        "shred_resources": f"""
          SELECT 'conv/' || conv_id AS item_id, resource_seq, CAST(NULL AS VARCHAR) AS fulltext_file, url,
                 nullif(role, '') AS caption
          FROM ({_CONV_RES})""",
        "shred_files": f"""
          SELECT 'conv/' || conv_id AS item_id, resource_seq, 0 AS file_seq, 0 AS format_seq,
                 'text/plain' AS mimetype, nullif(text, '') AS fulltext, CAST(NULL AS VARCHAR) AS url
          FROM ({_CONV_RES})
          UNION ALL
          SELECT 'conv/' || conv_id, resource_seq, 0, 1, 'text/xml', '<p>' || coalesce(text, '') || '</p>', NULL
          FROM ({_CONV_RES})
          UNION ALL
          SELECT 'conv/' || conv_id, resource_seq, 1, 0, 'image/jpeg', NULL, url || '.jpg'
          FROM ({_CONV_RES}) WHERE turn % 2 = 1""",
        "assemble_items": f"""
          SELECT 'conv/' || conv_id AS id, 'Conversation ' || conv_id AS title,
                 CAST(substr(CAST(DATE '2000-01-01' + CAST(conv_id AS INTEGER) AS VARCHAR), 1, 4) AS INTEGER) AS year,
                 CAST(count(*) AS INTEGER) AS n_resources,
                 CAST(2 * count(*) + count(*) FILTER (WHERE turn % 2 = 1) AS INTEGER) AS n_files
          FROM conversations GROUP BY conv_id""",
        "json_round_trip": with_ctes(["collections", "items_in_collections"], f"""
          {_record_sql()}
          UNION ALL
          SELECT 'collection' AS kind, id AS key,
                 title || '|' || CASE WHEN count > 0 THEN title || ' description' ELSE '' END || '|' || count AS value
          FROM collections
          UNION ALL
          SELECT 'page_item', collection_id, item_id FROM items_in_collections"""),
        "csv_round_trip": f"""
          SELECT {QS.uuid_sql("'doc/' || doc_id || ':quotations'")} AS job_id, CAST(doc_id AS VARCHAR) AS doc_id, text
          FROM documents""",
        "prediction_round_trip": QS.find_quotations_sql(QUOTATION_PARAMS),
        "insert_if_absent": f"""WITH {_LOADS}
          SELECT id, url, src FROM load1
          UNION ALL
          SELECT id, url, src FROM load2 WHERE seq = 0 AND id NOT IN (SELECT id FROM load1)""",
        "upsert_items": f"""WITH {_LOADS}
          SELECT id, url, src FROM load1 WHERE id NOT IN (SELECT id FROM load2)
          UNION ALL
          SELECT id, url, src FROM load2 WHERE seq = 1""",
        "replace_children": with_ctes(["files"], """
          SELECT item_id, resource_seq, file_seq, format_seq, mimetype, md5(coalesce(fulltext, '')) AS h
          FROM files WHERE item_id NOT IN (SELECT 'doc/' || page_id FROM pages WHERE page_id % 4 = 0)
          UNION ALL
          SELECT 'doc/' || page_id, 0, 0, 0, 'text/plain', md5('replaced doc/' || page_id)
          FROM pages WHERE page_id % 4 = 0"""),
        "cascade_delete": with_ctes(["items_in_collections", "files"], """
          SELECT 'links' AS tbl, item_id, collection_id AS detail FROM items_in_collections
          WHERE TRY_CAST(substr(item_id, 5) AS BIGINT) % 7 <> 0
             OR item_id NOT IN (SELECT 'doc/' || doc_id FROM documents)
          UNION ALL
          SELECT 'files', item_id, coalesce(mimetype, '-') FROM files
          WHERE item_id NOT IN (SELECT 'doc/' || doc_id FROM documents WHERE doc_id % 7 = 0)"""),
        "import_books": f"""WITH b1 AS ({STANDIN['books1']}), b2 AS ({STANDIN['books2']})
          SELECT lccn, title, {_book_year('publication_date')} AS year, array_to_string(language, ',') AS lang FROM b1
          UNION ALL
          SELECT lccn, title, {_book_year('publication_date')}, array_to_string(language, ',') FROM b2
          WHERE lccn NOT IN (SELECT lccn FROM b1)""",
    }
