"""Registered queries of the sinks: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import items as I
from ..operators import jobs as J
from ..operators import language as L
from ..operators import quotations as Q
from ..operators import tables as TB
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import standins as S
from ..sources.standins import with_ctes
from ..streaming import runners as RN
from . import processors as P
from . import q_language as QL
from . import quotation_sql as QS
from .q_tables import CLAIM_N, DEST, NOW_SQL, TS_SQL, _fmt, _now


def saved_quotations(spark, d):
    """Stored quotations with the counts that were observed while they were written."""
    from .catalog import _corpus, _docs_as_pages

    path = scratch_path(spark, "quotations")
    counts = Q.quotation_run(_docs_as_pages(spark, d), _corpus(spark, d), path)
    stored = spark.read.parquet(path)
    return stored.select("job_id", "item_id", "reference_id", "verse_id", F.round(F.col("probability").cast("double"), 6).alias("probability"),
                         *[F.lit(n).cast("long").alias(name) for name, n in counts.items()])


def saved_languages(spark, d):
    path = scratch_path(spark, "languages")
    L.save_language_counts(QL.language_counts(spark, d), path)
    return spark.read.parquet(path)


def exported_potential(spark, d):
    from .catalog import _corpus, _docs_as_pages

    path = scratch_path(spark, "potential")
    Q.export_potential(Q.potential_matches(_docs_as_pages(spark, d), _corpus(spark, d)), path)
    rows = spark.read.schema("item_id string, verse_id string, tokens double, tfidf double, proportion double").option("header", True).option("escape", '"').csv(path)
    return rows.select("item_id", "verse_id", "tokens", F.round("tfidf", 6).alias("tfidf"), F.round("proportion", 6).alias("proportion"))


def insert_links(spark, d):
    """First writer wins on a key of two columns: a second load repeats every link, and adds some."""
    links = S.items_in_collections(spark, d)
    half = F.regexp_extract("item_id", r"(\d)$", 1).isin("0", "2", "4", "6", "8")
    first = links.filter(half).withColumn("load", F.lit(1))
    second = links.withColumn("load", F.lit(2)).unionByName(links.withColumn("load", F.lit(3)))
    return TB.insert_if_absent(first, second, ["item_id", "collection_id"], order=["load"])


def book_metadata(spark, d):
    books = S.book_records(spark, d, 1).withColumn("publication_date", F.from_json("publication_date", "array<string>"))
    meta = RD.book_metadata_json(books)
    get = lambda path: F.get_json_object(meta, path)
    return books.select("lccn", get("$.lccn").alias("meta_lccn"), get("$.title").alias("title"), get("$.text_en").alias("text_en"), get("$.language[0]").alias("lang"))


def applied_claims(spark, d):
    """The whole jobs table after a claim was applied to it."""
    jobs = S.jobs(spark, d)
    out = J.apply_changes(jobs, J.claim_jobs(jobs, DEST, CLAIM_N, _now(spark, d)))
    return out.select("id", "item_id", "destination", "status", _fmt("started").alias("started"))


def touched_items(spark, d):
    return I.backfill_updated(S.items(spark, d), _now(spark, d)).select("id", "title", _fmt("updated").alias("updated"))


def collection_records(spark, d):
    """Raw records of landed listings, as kept in ``api``."""
    path = scratch_path(spark, "listings")
    rec = F.struct("id", "title", F.array(F.concat(F.lit("About "), "title")).alias("description"), "count")
    S.collections(spark, d).select(F.to_json(F.struct(F.array(rec).alias("results"))).alias("value")).write.text(path)
    got = RD.read_collections(spark, path, multiline=False)
    return got.select("id", "description", F.get_json_object("api", "$.id").alias("api_id"), F.get_json_object("api", "$.title").alias("api_title"),
                      F.get_json_object("api", "$.count").cast("int").alias("api_count"), F.get_json_object("api", "$.description[0]").alias("api_description"))


def routed_messages(spark, d):
    """The messages that the dead-letter rule lets pass."""
    docs = S.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    iid = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    whole = F.to_json(F.struct(R.uuid_of(iid, F.lit("language")).alias("job_id"), iid.alias("item_id"), F.col("text").alias("full_text")))
    landing, good, dead, ckpt = (scratch_path(spark, x) for x in ("landing-messages", "messages", "dead", "ckpt"))
    docs.select(F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("not json "), iid)).otherwise(whole).alias("value")).write.text(landing)
    RN.run(RN.route_messages(spark, landing, good, dead, ckpt))
    return spark.read.parquet(good).select("job_id", "item_id", F.length("full_text").cast("long").alias("n_chars"))


UNREADABLE = "[unreadable]"


@P.register_pages("line_counts", "lines long")
def line_counts(page: dict) -> list[dict]:
    """Example page processor: lines of a page; a page marked unreadable is an error."""
    if UNREADABLE in page["text"]:
        raise ValueError("unreadable page")
    return [{"lines": page["text"].count("\n") + 1}]


def _line_run(spark, d):
    conv = S.table(spark, d, "conversations")
    iid = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    body = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), F.lit(UNREADABLE)).otherwise(F.col("text"))
    items = conv.select(iid.alias("id")).distinct().withColumn("api", F.lit("{}"))
    files = conv.select(iid.alias("item_id"), F.col("turn").cast("int").alias("resource_seq"), F.lit(0).alias("file_seq"), F.lit(0).alias("format_seq"),
                        F.lit("text/plain").alias("mimetype"), body.alias("fulltext"))
    jobs = spark.createDataFrame([], "id string, item_id string, destination string, started timestamp, finished timestamp, status string")
    return P.run_page_processor("line_counts", items, jobs, files, F.current_timestamp(), scratch_path(spark, "line-counts"))


def page_processor_run(spark, d):
    return _line_run(spark, d).results.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("lines").alias("lines"))


def page_processor_jobs(spark, d):
    run = _line_run(spark, d)
    return run.jobs.join(run.errors.select(F.col("job_id").alias("id"), "error"), "id", "left").select("id", "item_id", "destination", "status", "error")


QUERIES = {f.__name__: f for f in (saved_quotations, saved_languages, exported_potential, insert_links, book_metadata, applied_claims, touched_items,
                                   collection_records, routed_messages, page_processor_run, page_processor_jobs)}


def sql() -> dict[str, str]:
    from .catalog import QUOTATION_PARAMS as p

    found = QS.find_quotations_sql(p)
    uuid = QS.uuid_sql
    failed = "SELECT conv_id FROM conversations WHERE conv_id % 7 = 3 AND turn = 0"
    return {
        "saved_quotations": f"""
          SELECT f.* REPLACE (round(CAST(CAST(probability AS FLOAT) AS DOUBLE), 6) AS probability), m.n_potential, m.n_kept, (SELECT count(*) FROM ({found})) AS n_quotations
          FROM ({found}) f, ({QS.match_statistics_sql(p)}) m""",
        "saved_languages": f"""WITH {QL._mixed_counts_sql()}
          SELECT {uuid("item_id || ':language'")} AS job_id, item_id, lang, sentences FROM counts""",
        "exported_potential": QS.potential_matches_sql(p).replace("SELECT item_id, verse_id, tokens,", "SELECT item_id, verse_id, CAST(tokens AS DOUBLE) AS tokens,"),
        "insert_links": with_ctes(["items_in_collections"], """
          SELECT item_id, collection_id, CASE WHEN CAST(item_id[-1] AS INTEGER) % 2 = 0 THEN 1 ELSE 2 END AS load FROM items_in_collections"""),
        "book_metadata": f"""WITH b AS ({S.SQL['books1']}) SELECT lccn, lccn AS meta_lccn, title, '' AS text_en, language[1] AS lang FROM b""",
        "applied_claims": with_ctes(["jobs"], f"""
          SELECT j.id, j.item_id, j.destination, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE j.status END AS status,
                 {TS_SQL.format(c=f"CASE WHEN c.id IS NOT NULL THEN {NOW_SQL} ELSE j.started END")} AS started
          FROM jobs j LEFT JOIN (SELECT id FROM jobs WHERE status = 'ready' AND destination = '{DEST}' ORDER BY id LIMIT {CLAIM_N}) c ON c.id = j.id"""),
        "touched_items": with_ctes(["items"], f"SELECT id, title, {TS_SQL.format(c=NOW_SQL)} AS updated FROM items"),
        "collection_records": with_ctes(["collections"], """
          SELECT id, 'About ' || title AS description, id AS api_id, title AS api_title, count AS api_count, 'About ' || title AS api_description FROM collections"""),
        "routed_messages": f"""
          SELECT {uuid("'doc/' || doc_id || ':language'")} AS job_id, 'doc/' || doc_id AS item_id, length(coalesce(text, ''))::BIGINT AS n_chars
          FROM documents WHERE doc_id % 17 <> 0""",
        "page_processor_run": f"""
          SELECT 'conv/' || conv_id AS item_id, count(*) AS n_pages, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines
          FROM conversations WHERE conv_id NOT IN ({failed}) GROUP BY conv_id""",
        "page_processor_jobs": f"""
          SELECT {uuid("'conv/' || conv_id || ':line_counts'")} AS id, 'conv/' || conv_id AS item_id, 'line_counts' AS destination,
                 CASE WHEN conv_id IN ({failed}) THEN 'failed' ELSE 'finished' END AS status,
                 CASE WHEN conv_id IN ({failed}) THEN 'ValueError: unreadable page' END AS error
          FROM (SELECT DISTINCT conv_id FROM conversations)""",
    }
