"""Stand-in tables derived by fixed rules from the driver's Parquet tables.

Each rule exists twice: as a Spark function here and as a SQL fragment
(``SQL[name]``) that the DuckDB oracle uses.  Keep the pairs in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import year_of
from ..functions.records import JOB_STATUSES, TAG_NAMES, map_lookup, uuid_of
from ..functions.text import drop_last_words

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

ITEM_BASE = "https://x.example/item/"
RESOURCE_BASE = "https://x.example/resource/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lang_name(col):
    return map_lookup(col, TAG_NAMES)


def items(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    item_id = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    api_id = F.when(F.col("doc_id") % 97 == 1, F.concat(item_id, F.lit("-x"))).otherwise(item_id)
    date = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int")).cast("string")
    api = F.when(F.col("doc_id") % 5 != 0,
                 F.concat(F.lit('{"item":{"id":"'), api_id, F.lit('","language":["'),
                          _lang_name(F.col("lang")), F.lit('"]}}')))
    return docs.select(
        item_id.alias("id"),
        F.concat(F.when(F.col("doc_id") % 11 == 0, F.lit(RESOURCE_BASE)).otherwise(F.lit(ITEM_BASE)),
                 F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        year_of(date).alias("year"),
        date.alias("date"),
        F.array(F.col("source"), F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).alias("subjects"),
        F.array(_lang_name(F.col("lang"))).alias("languages"),
        api.alias("api"),
        # Zone-free timestamp so the rule reads the same in every session time zone.
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("updated"),
    )


def collections(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    real = docs.groupBy("source").agg(F.count(F.lit(1)).alias("count")) \
        .select(F.col("source").alias("id"), F.concat(F.lit("Collection "), F.col("source")).alias("title"),
                F.col("count").cast("int").alias("count"))
    empty = docs.sparkSession.createDataFrame(
        [("empty-a", "Collection empty-a", 0), ("empty-b", "Collection empty-b", 0)], "id string, title string, count int")
    return real.unionByName(empty)


def items_in_collections(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"),
        F.col("source").alias("collection_id"))


#: Ends every fourth markup file: references of all kinds, a ">" in a value, an element and a comment that never end.
MORE_MARKUP = """<p title="a > b" class='c>d'>R&eacute;sum&#233; &#x2014; 5 &lt; 6 &notit; &amp;lt; &copy 7 < 8 &#128; &#0; &unknown; &<i>x</i></p><style>p{}"""


def files(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "html")
    docs = table(spark, d, "documents").select("doc_id", "text")
    item_id = F.concat(F.lit("doc/"), F.col("page_id").cast("string"))
    xml = pages.select(item_id.alias("item_id"), F.lit(0).alias("resource_seq"), F.lit(0).alias("file_seq"),
                       F.lit(0).alias("format_seq"), F.lit("text/xml").alias("mimetype"),
                       F.when(F.col("page_id") % 7 != 3, F.when(F.col("page_id") % 4 == 1, F.concat("html", F.lit(MORE_MARKUP))).otherwise(F.col("html"))).alias("fulltext"))
    # Every document is a plain file: of its page's item or, where that item
    # shall have markup only, of an item of its own.
    other = F.col("page_id").isNotNull() & (F.col("page_id") % 3 != 0)
    plain = docs.join(pages.select("page_id"), F.col("doc_id") == F.col("page_id"), "left").select(
        F.concat(F.when(other, F.lit("text/")).otherwise(F.lit("doc/")), F.col("doc_id").cast("string")).alias("item_id"),
        F.lit(0).alias("resource_seq"), F.lit(0).alias("file_seq"),
        F.lit(1).alias("format_seq"), F.lit("text/plain").alias("mimetype"), F.col("text").alias("fulltext"))
    nulls = pages.filter(F.col("page_id") % 10 == 0).select(
        item_id.alias("item_id"), F.lit(0).alias("resource_seq"), F.lit(1).alias("file_seq"),
        F.lit(0).alias("format_seq"), F.lit(None).cast("string").alias("mimetype"),
        F.lit(None).cast("string").alias("fulltext"))
    return xml.unionByName(plain).unionByName(nulls)


def doc_pages(spark, d) -> DataFrame:
    """Lines of each document as pages, plus conversation turns as pages."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"),
                        F.posexplode(F.split(F.col("text"), "\n")).alias("page_seq", "text"))
    conv = table(spark, d, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("item_id"),
        F.col("turn").cast("int").alias("page_seq"), "text")
    return lines.select("item_id", F.col("page_seq").cast("int"), "text").unionByName(conv)


def mixed_items(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        (F.col("doc_id") / 3).cast("long").alias("item_id"),
        (F.col("doc_id") % 3).cast("int").alias("page_seq"), "text", "lang")


def verses(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    a = b.select(F.concat(F.lit("Passage "), F.col("item_id").cast("string"), F.lit(" (KJV)")).alias("verse_id"), "text")
    c = b.select(F.concat(F.lit("Passage "), F.col("item_id").cast("string"), F.lit(" (ASV)")).alias("verse_id"),
                 drop_last_words(F.col("text"), 2).alias("text"))
    return a.unionByName(c)


def jobs(spark, d) -> DataFrame:
    from ..operators.tables import first_per_key
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    ev = first_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"])
    status = F.element_at(F.array(*[F.lit(s) for s in JOB_STATUSES]), (F.col("event_id") % 5 + 1).cast("int"))
    item_id = F.concat(F.lit("doc/"), F.col("user_id").cast("string"))
    return ev.select(
        uuid_of(item_id, F.col("event_type")).alias("id"),
        item_id.alias("item_id"),
        F.col("event_type").alias("destination"),
        status.alias("status"), "ts").select(
        "id", "item_id", "destination",
        F.when(F.col("status") != "ready", F.col("ts")).alias("started"),
        F.when(~F.col("status").isin("ready", "running"), F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("finished"),
        "status")


def failures(spark, d) -> DataFrame:
    ev = table(spark, d, "events").filter(F.col("event_type") == "error")
    return ev.groupBy("user_id").agg(F.max("ts").alias("failed_at")).select(
        F.concat(F.lit("doc/"), F.col("user_id").cast("string")).alias("item_id"), "failed_at")


def events_now(spark, d):
    """The fixed 'now' of the failure rules: the latest event time."""
    return table(spark, d, "events").agg(F.max("ts").alias("now"))


def book_records(spark, d, load: int) -> DataFrame:
    """Book export records; load 1 = doc_id % 4 in (0, 1), load 2 = (1, 2, 3)."""
    docs = table(spark, d, "documents")
    keep = [0, 1] if load == 1 else [1, 2, 3]
    date = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int")).cast("string")
    pub = F.when(F.col("doc_id") % 13 == 0, F.lit('["unknown"]')) \
        .otherwise(F.concat(F.lit('["'), date, F.lit('"]')))
    return docs.filter((F.col("doc_id") % 4).isin(keep)).select(
        F.col("doc_id").cast("string").alias("lccn"),
        F.concat(F.lit("Book "), F.col("doc_id").cast("string"), F.lit(f" v{load}")).alias("title"),
        pub.alias("publication_date"),
        F.array(_lang_name(F.col("lang"))).alias("language"),
        F.col("text").alias("text_en"))


# ---------------------------------------------------------------------------
# The same rules in SQL (DuckDB dialect), used as CTEs by the oracle.
# ---------------------------------------------------------------------------

LANG_NAME_SQL = ("CASE {c} WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' "
                 "WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END")

YEAR_SQL = ("CASE WHEN length({c}) >= {m} AND regexp_full_match(substr({c}, 1, 4), '[+-]?[0-9]+') "
            "THEN TRY_CAST(substr({c}, 1, 4) AS INTEGER) END")

SQL = {
    "items": f"""
      SELECT 'doc/' || doc_id AS id,
             CASE WHEN doc_id % 11 = 0 THEN '{RESOURCE_BASE}' ELSE '{ITEM_BASE}' END || doc_id AS url,
             'Document ' || doc_id AS title,
             {YEAR_SQL.format(c="CAST(DATE '1900-01-01' + CAST(doc_id % 9000 AS INTEGER) AS VARCHAR)", m=5)} AS year,
             CAST(DATE '1900-01-01' + CAST(doc_id % 9000 AS INTEGER) AS VARCHAR) AS date,
             [source, 's' || (doc_id % 7)] AS subjects,
             [{LANG_NAME_SQL.format(c='lang')}] AS languages,
             CASE WHEN doc_id % 5 <> 0 THEN '{{"item":{{"id":"' ||
                  CASE WHEN doc_id % 97 = 1 THEN 'doc/' || doc_id || '-x' ELSE 'doc/' || doc_id END ||
                  '","language":["' || {LANG_NAME_SQL.format(c='lang')} || '"]}}}}' END AS api,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS updated
      FROM documents""",
    "collections": """
      SELECT source AS id, 'Collection ' || source AS title, CAST(count(*) AS INTEGER) AS count
      FROM documents GROUP BY source
      UNION ALL SELECT 'empty-a', 'Collection empty-a', 0
      UNION ALL SELECT 'empty-b', 'Collection empty-b', 0""",
    "items_in_collections": "SELECT 'doc/' || doc_id AS item_id, source AS collection_id FROM documents",
    "files": f"""
      SELECT 'doc/' || page_id AS item_id, 0 AS resource_seq, 0 AS file_seq, 0 AS format_seq,
             'text/xml' AS mimetype, CASE WHEN page_id % 7 <> 3 THEN CASE WHEN page_id % 4 = 1 THEN html || '{MORE_MARKUP.replace("'", "''")}' ELSE html END END AS fulltext FROM pages
      UNION ALL
      SELECT CASE WHEN p.page_id % 3 <> 0 THEN 'text/' ELSE 'doc/' END || d.doc_id, 0, 0, 1, 'text/plain', d.text
      FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id
      UNION ALL
      SELECT 'doc/' || page_id, 0, 1, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
      FROM pages WHERE page_id % 10 = 0""",
    "doc_pages": """
      SELECT item_id, CAST(page_seq AS INTEGER) AS page_seq, text FROM (
        SELECT 'doc/' || doc_id AS item_id,
               unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS page_seq,
               unnest(string_split(text, chr(10))) AS text
        FROM documents)
      UNION ALL
      SELECT 'conv/' || conv_id, CAST(turn AS INTEGER), text FROM conversations""",
    "mixed_items": """
      SELECT CAST(doc_id // 3 AS BIGINT) AS item_id, CAST(doc_id % 3 AS INTEGER) AS page_seq, text, lang
      FROM documents""",
    "verses": r"""
      SELECT 'Passage ' || item_id || ' (KJV)' AS verse_id, text FROM benchmark
      UNION ALL
      SELECT 'Passage ' || item_id || ' (ASV)', regexp_replace(text, '\s*\S+\s+\S+\s*$', '') FROM benchmark""",
    "jobs": """
      SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
             substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
             item_id, destination,
             CASE WHEN status <> 'ready' THEN ts END AS started,
             CASE WHEN status NOT IN ('ready', 'running') THEN ts + INTERVAL 10 MINUTE END AS finished,
             status
      FROM (
        SELECT md5('doc/' || user_id || ':' || event_type) AS h, 'doc/' || user_id AS item_id,
               event_type AS destination, ts,
               (['ready', 'running', 'skipped', 'failed', 'finished'])[event_id % 5 + 1] AS status,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
        FROM events) WHERE rn = 1""",
    "failures": """
      SELECT 'doc/' || user_id AS item_id, max(ts) AS failed_at FROM events
      WHERE event_type = 'error' GROUP BY user_id""",
    "books1": f"""
      SELECT CAST(doc_id AS VARCHAR) AS lccn, 'Book ' || doc_id || ' v1' AS title,
             CASE WHEN doc_id % 13 = 0 THEN '["unknown"]'
                  ELSE '["' || CAST(DATE '1900-01-01' + CAST(doc_id % 9000 AS INTEGER) AS VARCHAR) || '"]' END
               AS publication_date,
             [{LANG_NAME_SQL.format(c='lang')}] AS language, text AS text_en
      FROM documents WHERE doc_id % 4 IN (0, 1)""",
    "books2": f"""
      SELECT CAST(doc_id AS VARCHAR) AS lccn, 'Book ' || doc_id || ' v2' AS title,
             CASE WHEN doc_id % 13 = 0 THEN '["unknown"]'
                  ELSE '["' || CAST(DATE '1900-01-01' + CAST(doc_id % 9000 AS INTEGER) AS VARCHAR) || '"]' END
               AS publication_date,
             [{LANG_NAME_SQL.format(c='lang')}] AS language, text AS text_en
      FROM documents WHERE doc_id % 4 IN (1, 2, 3)""",
}


def with_ctes(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Build ``WITH name AS (...), ... body`` from the SQL stand-ins."""
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
