"""Registered queries over the item, collection, file and job tables.

Each query has a Spark plan (``QUERIES``) and its SQL form (``SQL``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import records as R
from ..functions.markup import markup_sql
from ..operators import items as I
from ..operators import jobs as J
from ..operators import stats as ST
from ..sources import standins as S
from ..sources.standins import YEAR_SQL, with_ctes

DEST = "click"          # destination used for job queries (a destination in the jobs stand-in)
CLAIM_N = 10            # jobs claimed per call
TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _fmt(col):
    return F.date_format(col, TS_FMT)


def _now(spark, d):
    """The fixed 'now' of these queries (latest event time) as a literal."""
    now = S.table(spark, d, "events").agg(F.max("ts")).first()[0]
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# --- stats views -------------------------------------------------------------

def mimetype_counts(spark, d):
    return ST.count_mimetypes(S.files(spark, d))


def items_per_group(spark, d):
    return ST.items_per_collection(S.collections(spark, d), S.items_in_collections(spark, d))


def items_status(spark, d):
    return ST.items_status(S.items(spark, d))


def job_status(spark, d):
    return ST.job_status(S.jobs(spark, d))


# --- jobs ------------------------------------------------------------------------

def unqueued_items(spark, d):
    return J.unqueued_items(S.items(spark, d), S.jobs(spark, d), DEST).select("id")


def queued_items(spark, d):
    return J.queued_items(S.items(spark, d), S.jobs(spark, d), DEST).select("id")


def ready_jobs(spark, d):
    return J.ready_jobs(S.jobs(spark, d), DEST).select("id", "item_id")


def job_lists(spark, d):
    return J.job_lists(S.jobs(spark, d))


def create_jobs(spark, d):
    return J.create_jobs(S.items(spark, d), S.jobs(spark, d), DEST).select("id", "item_id", "destination", "status")


def claim_jobs(spark, d):
    c = J.claim_jobs(S.jobs(spark, d), DEST, CLAIM_N, _now(spark, d))
    return c.select("id", "item_id", "status", _fmt("started").alias("started"))


def end_jobs(spark, d):
    jobs = S.jobs(spark, d)
    running = jobs.filter(F.col("status") == "running")
    out = J.job_outcomes(running, S.items(spark, d), I.items_with_text(S.files(spark, d)))
    ended = J.end_jobs(jobs, out, _now(spark, d))
    return ended.select("id", "status", _fmt("finished").alias("finished"))


def retry_jobs(spark, d):
    jobs = S.jobs(spark, d)
    results = jobs.select(F.col("id").alias("job_id"), "item_id")
    kept, (res,) = J.retry_jobs(jobs, [results])
    return kept.select(F.lit("job").alias("kind"), "id").unionByName(
        res.select(F.lit("result").alias("kind"), F.col("job_id").alias("id")))


def job_pages(spark, d):
    pages = I.page_text(S.files(spark, d))
    return J.job_pages(S.jobs(spark, d), pages, DEST).select(
        "job_id", "item_id", *I.PAGE_KEYS, "text")


def skipped_jobs(spark, d):
    pages = I.page_text(S.files(spark, d))
    return J.skipped_jobs(S.jobs(spark, d), pages, DEST).select("id", "item_id")


# --- items -----------------------------------------------------------------------

def fetch_backlog(spark, d):
    return I.fetch_backlog(S.items(spark, d), S.failures(spark, d), _now(spark, d)).select("id")


def backlog_gate(spark, d):
    return I.backlog_gate(S.items(spark, d), S.failures(spark, d), _now(spark, d))


def unfetched_items(spark, d):
    return I.unfetched(S.items(spark, d)).select("id", _fmt("updated").alias("updated"))


def page_text(spark, d):
    return I.page_text(S.files(spark, d))


def item_manifest(spark, d):
    p = S.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return I.item_manifest(p).withColumnRenamed("id", "page_id")


def _collection_urls(spark, d):
    c = S.collections(spark, d)
    even = F.col("id").rlike("[02468]$")
    url = F.when(even, F.concat(F.lit(R.API_BASE + "/collections/"), F.col("id"), F.lit("/?fa=partof")))\
        .otherwise(F.concat(F.lit("https://memory.example/"), F.col("id"), F.lit("/")))
    return c.withColumn("items_url", url)


PER_PAGE = 10


def page_manifest(spark, d):
    return I.page_manifest(_collection_urls(spark, d), PER_PAGE)


def year_variants(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                                         "o_orderpriority")
    return o.select("o_orderkey", "d",
                    DT.year_of(F.col("d")).alias("y_strict"),
                    DT.year_of(F.substring("d", 1, 4)).alias("y_strict_short"),
                    DT.year_of(F.substring("d", 1, 4), min_len=4).alias("y_lenient_short"),
                    DT.year_of(F.concat(F.lit(" "), F.col("d"))).alias("y_blank"),
                    DT.book_year(F.concat(F.lit('{"publication_date":["'), F.col("d"), F.lit('"]}'))).alias("y_book"),
                    DT.book_year(F.col("o_orderpriority")).alias("y_book_none"))


def array_search(spark, d):
    it = S.items(spark, d)
    a = I.array_search(it, "subjects", ["s3", "src5"], "any").select(F.lit("any").alias("mode"), "id")
    b = I.array_search(it, "languages", ["french"], "all").select(F.lit("all").alias("mode"), "id")
    return a.unionByName(b)


def year_range(spark, d):
    return I.in_range(S.items(spark, d), "year", 1901, 1902).select("id", "year")


def backfill_languages(spark, d):
    it = S.items(spark, d).withColumn("languages", F.lit(None).cast("array<string>"))
    filled = I.backfill_updated(I.backfill_languages(it), F.current_timestamp())
    return filled.select("id", F.array_join("languages", ",").alias("languages"))


def json_extract(spark, d):
    ev = S.table(spark, d, "events")
    k = R.json_path(F.col("props"), "$.k").try_cast("long")
    return ev.groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"))


def point_lookup(spark, d):
    return S.items(spark, d).filter(F.col("id") == "doc/7").select("id", "url", "title", "year", "date")


def key_audit(spark, d):
    """Key and domain rules of labels, jobs and items, each table read once."""
    outside = F.col("status").isNull() | ~F.col("status").isin(*R.JOB_STATUSES)
    labels = ST.audit(S.table(spark, d, "labels"), "labels", [["doc_id"]],
                      {f"{c} is null": (F.col(c).isNull(), ["doc_id"]) for c in ("quality", "toxic")})
    jobs = ST.audit(S.jobs(spark, d), "jobs", [["item_id", "destination"]],
                    {"status outside enum": (outside, ["id"]), "id not a uuid": (F.col("id").isNull() | ~R.is_uuid(F.col("id")), ["id"])})
    items = ST.audit(S.items(spark, d), "items", checks={"record id differs": (F.get_json_object("api", "$.item.id") != F.col("id"), ["id"])})
    return labels.unionByName(jobs).unionByName(items)


def fk_audit(spark, d):
    li = S.table(spark, d, "lineitem")
    orders = S.table(spark, d, "orders")
    labels = S.table(spark, d, "labels")
    docs = S.table(spark, d, "documents")
    return ST.orphans(li, orders, ["l_orderkey"], ["o_orderkey"], "lineitem").unionByName(
        ST.orphans(labels, docs, ["doc_id"], ["doc_id"], "labels")).unionByName(
        ST.orphans(S.files(spark, d), S.items(spark, d), ["item_id"], ["id"], "files")).unionByName(
        ST.orphans(S.jobs(spark, d), S.items(spark, d), ["item_id"], ["id"], "jobs"))


QUERIES = {
    "mimetype_counts": mimetype_counts, "items_per_group": items_per_group, "items_status": items_status,
    "job_status": job_status, "unqueued_items": unqueued_items, "queued_items": queued_items,
    "ready_jobs": ready_jobs, "job_lists": job_lists, "create_jobs": create_jobs, "claim_jobs": claim_jobs,
    "end_jobs": end_jobs, "retry_jobs": retry_jobs, "job_pages": job_pages, "skipped_jobs": skipped_jobs,
    "fetch_backlog": fetch_backlog, "backlog_gate": backlog_gate, "unfetched_items": unfetched_items,
    "page_text": page_text, "item_manifest": item_manifest, "page_manifest": page_manifest,
    "year_variants": year_variants, "array_search": array_search, "year_range": year_range,
    "backfill_languages": backfill_languages, "json_extract": json_extract, "point_lookup": point_lookup,
    "key_audit": key_audit, "fk_audit": fk_audit,
}

# ---------------------------------------------------------------------------
# SQL forms
# ---------------------------------------------------------------------------

NOW_SQL = "(SELECT max(ts) FROM events)"


XML_ONLY_SQL = """(SELECT * FROM files f WHERE mimetype = 'text/xml' AND fulltext IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM files p WHERE p.item_id = f.item_id AND p.mimetype = 'text/plain'
                    AND p.fulltext IS NOT NULL))"""

PAGE_TEXT_SQL = f"""
  SELECT item_id, resource_seq, file_seq, format_seq, fulltext AS text FROM files
  WHERE mimetype = 'text/plain' AND fulltext IS NOT NULL
  UNION ALL
  {markup_sql('fulltext', XML_ONLY_SQL, 'item_id, resource_seq, file_seq, format_seq')}"""

COLL_URL_SQL = (f"CASE WHEN regexp_matches(id, '[02468]$') THEN '{R.API_BASE}/collections/' || id || '/?fa=partof' "
                f"ELSE 'https://memory.example/' || id || '/' END")


def _book_year_sql(c: str) -> str:
    found = f"regexp_extract({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0)"
    return f"CAST(coalesce(CASE WHEN {found} <> '' THEN TRY_CAST(substr({found}, 1, 4) AS INTEGER) END, 0) AS INTEGER)"


def _audit_sql() -> str:
    return """
  SELECT 'labels' AS "table", 'duplicate key' AS rule, CAST(doc_id AS VARCHAR) AS key, count(*) AS n
  FROM labels GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'labels', 'quality is null', CAST(doc_id AS VARCHAR), 1 FROM labels WHERE quality IS NULL
  UNION ALL SELECT 'labels', 'toxic is null', CAST(doc_id AS VARCHAR), 1 FROM labels WHERE toxic IS NULL
  UNION ALL SELECT 'jobs', 'duplicate key', item_id || '|' || destination, count(*) FROM jobs
            GROUP BY item_id, destination HAVING count(*) > 1
  UNION ALL SELECT 'jobs', 'status outside enum', id, 1 FROM jobs
            WHERE status IS NULL OR status NOT IN ('ready', 'running', 'skipped', 'failed', 'finished')
  UNION ALL SELECT 'jobs', 'id not a uuid', coalesce(id, ''), 1 FROM jobs
            WHERE id IS NULL OR NOT regexp_full_match(id,
              '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
  UNION ALL SELECT 'items', 'record id differs', id, 1 FROM items
            WHERE api IS NOT NULL AND json_extract_string(api, '$.item.id') <> id"""


def sql() -> dict[str, str]:
    ts = TS_SQL.format
    return {
        "mimetype_counts": with_ctes(["files"], "SELECT mimetype, count(*) AS n FROM files GROUP BY mimetype"),
        "items_per_group": with_ctes(["collections", "items_in_collections"], """
          SELECT c.title, count(l.collection_id) AS n_items, c.id
          FROM collections c LEFT JOIN items_in_collections l ON c.id = l.collection_id
          GROUP BY c.id, c.title"""),
        "items_status": with_ctes(["items"], """
          SELECT 'total items' AS type, count(*) AS n FROM items
          UNION SELECT 'fetched items', count(*) FROM items WHERE api IS NOT NULL
          UNION SELECT 'unfetched items', count(*) FROM items WHERE api IS NULL"""),
        "job_status": with_ctes(["jobs"], """
          SELECT destination, status, count(*) AS num_jobs FROM jobs GROUP BY destination, status"""),
        "unqueued_items": with_ctes(["items", "jobs"], f"""
          SELECT id FROM items i WHERE api IS NOT NULL AND NOT EXISTS
            (SELECT 1 FROM jobs j WHERE j.destination = '{DEST}' AND j.item_id = i.id)"""),
        "queued_items": with_ctes(["items", "jobs"], f"""
          SELECT id FROM items i WHERE EXISTS
            (SELECT 1 FROM jobs j WHERE j.destination = '{DEST}' AND j.item_id = i.id)"""),
        "ready_jobs": with_ctes(["jobs"], f"""
          SELECT id, item_id FROM jobs WHERE status = 'ready' AND destination = '{DEST}'"""),
        "job_lists": with_ctes(["jobs"], """
          SELECT * FROM (SELECT id, item_id, destination,
                 CASE WHEN status = 'skipped' THEN 'skipped'
                      WHEN started IS NOT NULL AND finished IS NULL THEN 'in progress'
                      WHEN finished IS NOT NULL AND status = 'finished' THEN 'finished' END AS list
          FROM jobs) WHERE list IS NOT NULL"""),
        "create_jobs": with_ctes(["items", "jobs"], f"""
          SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
                 substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id, item_id,
                 '{DEST}' AS destination, 'ready' AS status
          FROM (SELECT DISTINCT id AS item_id, md5(id || ':{DEST}') AS h FROM items i
                WHERE api IS NOT NULL AND NOT EXISTS
                  (SELECT 1 FROM jobs j WHERE j.destination = '{DEST}' AND j.item_id = i.id))"""),
        "claim_jobs": with_ctes(["jobs"], f"""
          SELECT id, item_id, 'running' AS status, {ts(c=NOW_SQL)} AS started
          FROM jobs WHERE status = 'ready' AND destination = '{DEST}' ORDER BY id LIMIT {CLAIM_N}"""),
        "end_jobs": with_ctes(["jobs", "items", "files"], f"""
          SELECT j.id, coalesce(o.outcome, j.status) AS status,
                 {ts(c=f"CASE WHEN o.outcome IS NOT NULL THEN {NOW_SQL} ELSE j.finished END")} AS finished
          FROM jobs j LEFT JOIN (
            SELECT r.id, CASE WHEN i.id IS NULL THEN 'failed'
                              WHEN t.item_id IS NULL THEN 'skipped' ELSE 'finished' END AS outcome
            FROM jobs r LEFT JOIN items i ON i.id = r.item_id
                        LEFT JOIN (SELECT DISTINCT item_id FROM files WHERE fulltext IS NOT NULL
                                   AND mimetype IN ('text/plain', 'text/xml')) t ON t.item_id = r.item_id
            WHERE r.status = 'running') o ON o.id = j.id"""),
        "retry_jobs": with_ctes(["jobs"], """
          SELECT 'job' AS kind, id FROM jobs WHERE status NOT IN ('skipped', 'failed') OR status IS NULL
          UNION ALL
          SELECT 'result', id FROM jobs WHERE status NOT IN ('skipped', 'failed') OR status IS NULL"""),
        "job_pages": with_ctes(["jobs", "files"], f"""
          SELECT j.id AS job_id, p.item_id, p.resource_seq, p.file_seq, p.format_seq, p.text
          FROM jobs j JOIN pages_text p ON p.item_id = j.item_id
          WHERE j.destination = '{DEST}' AND j.status = 'running'""", [("pages_text", PAGE_TEXT_SQL)]),
        "skipped_jobs": with_ctes(["jobs", "files"], f"""
          SELECT id, item_id FROM jobs j WHERE j.destination = '{DEST}' AND j.status = 'running'
            AND NOT EXISTS (SELECT 1 FROM pages_text p WHERE p.item_id = j.item_id)""",
                                  [("pages_text", PAGE_TEXT_SQL)]),
        "fetch_backlog": with_ctes(["items", "failures"], f"""
          SELECT i.id FROM items i LEFT JOIN failures f ON f.item_id = i.id
          WHERE i.api IS NULL AND strpos(i.url, '/resource/') = 0
            AND (f.failed_at IS NULL OR f.failed_at <= {NOW_SQL} - INTERVAL 60 MINUTE)"""),
        "backlog_gate": with_ctes(["items", "failures"], f"""
          SELECT u.n AS n_unfetched, c.n AS n_cooling, (u.n > 0 AND c.n < u.n) AS work
          FROM (SELECT count(*) FILTER (WHERE api IS NULL) AS n FROM items) u,
               (SELECT count(*) FILTER (WHERE failed_at > {NOW_SQL} - INTERVAL 60 MINUTE) AS n FROM failures) c"""),
        "unfetched_items": with_ctes(["items"], f"""
          SELECT id, {ts(c='updated')} AS updated FROM items WHERE api IS NULL"""),
        "page_text": with_ctes(["files"], PAGE_TEXT_SQL),
        "item_manifest": f"""
          SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?{R.ITEM_QUERY}' AS fetch_url
          FROM pages WHERE strpos(url, '/resource/') = 0""",
        "page_manifest": with_ctes(["collections"], f"""
          SELECT id AS collection_id, CAST(page AS INTEGER) AS page,
                 regexp_replace(items_url, '[?#].*$', '') || '?{R.PAGE_QUERY.split('{page}')[0].format(per_page=PER_PAGE)}'
                   || page || '{R.PAGE_QUERY.split('{page}')[1]}' AS url
          FROM (SELECT id, items_url,
                       unnest(generate_series(1, greatest(1, CAST(ceil(count / {PER_PAGE}) AS INTEGER)))) AS page
                FROM (SELECT *, {COLL_URL_SQL} AS items_url FROM collections)
                WHERE starts_with(items_url, '{R.API_BASE}'))"""),
        "year_variants": f"""
          SELECT o_orderkey, d,
                 {YEAR_SQL.format(c='d', m=5)} AS y_strict,
                 {YEAR_SQL.format(c='substr(d, 1, 4)', m=5)} AS y_strict_short,
                 {YEAR_SQL.format(c='substr(d, 1, 4)', m=4)} AS y_lenient_short,
                 {YEAR_SQL.format(c="(' ' || d)", m=5)} AS y_blank,
                 {_book_year_sql(chr(39) + '{"publication_date":["' + chr(39) + ' || d || ' + chr(39) + '"]}' + chr(39))} AS y_book,
                 {_book_year_sql('o_orderpriority')} AS y_book_none
          FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority FROM orders)""",
        "array_search": with_ctes(["items"], """
          SELECT 'any' AS mode, id FROM items WHERE list_has_any(subjects, ['s3', 'src5'])
          UNION ALL SELECT 'all', id FROM items WHERE list_has_all(languages, ['french'])"""),
        "year_range": with_ctes(["items"], "SELECT id, year FROM items WHERE year BETWEEN 1901 AND 1902"),
        "backfill_languages": with_ctes(["items"], """
          SELECT id, CASE WHEN api IS NOT NULL THEN
                   array_to_string(CAST(json_extract(api, '$.item.language') AS VARCHAR[]), ',') END AS languages
          FROM items"""),
        "json_extract": """
          SELECT event_type, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
                 count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k
          FROM events GROUP BY event_type""",
        "point_lookup": with_ctes(["items"], "SELECT id, url, title, year, date FROM items WHERE id = 'doc/7'"),
        "key_audit": with_ctes(["items", "jobs"], _audit_sql()),
        "fk_audit": with_ctes(["items", "files", "jobs"], """
          SELECT 'lineitem' AS "table", 'orphan' AS rule, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n
          FROM lineitem l WHERE l_orderkey IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) GROUP BY l_orderkey
          UNION ALL
          SELECT 'labels', 'orphan', CAST(doc_id AS VARCHAR), count(*) FROM labels b WHERE doc_id IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.doc_id) GROUP BY doc_id
          UNION ALL
          SELECT 'files', 'orphan', item_id, count(*) FROM files f
          WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id = f.item_id) GROUP BY item_id
          UNION ALL
          SELECT 'jobs', 'orphan', item_id, count(*) FROM jobs j
          WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.id = j.item_id) GROUP BY item_id"""),
    }
