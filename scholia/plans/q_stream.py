"""Registered queries for streaming, user processors and model fitting.

Streaming queries land files derived from the driver's tables in a fresh
folder below the shared checkpoint folder, run the stream with an
``availableNow`` trigger and return the table it produced.
"""

from __future__ import annotations

import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import word_tokens
from ..operators import quotations as Q
from ..sources import standins as S
from ..streaming import keyed as K
from ..streaming import runners as RN
from ..session import cut_lineage, scratch_path
from . import processors as P
from . import q_language as QL
from . import quotation_sql as QS
from .catalog import QUOTATION_PARAMS

LANDINGS = 3     # number of separate landings the input arrives in
PAGE_ITEMS = 50   # entries of a result page
FILES = 2        # files a landing has at least; a micro-batch takes as many as a landing has, so that a stream has several


def _land_parquet(df, root, key_col):
    """Write df in LANDINGS appends, each of as many files as df has parts; the pages of an item are spread over all of them.

    Rows are dealt in turn: a file, and the task that writes it, gets its
    share whatever the keys.  Returns the number of files of a landing."""
    files = max(FILES, df.rdd.getNumPartitions())
    for i in range(LANDINGS):
        part = df.filter(F.pmod(F.xxhash64(key_col, "page_seq"), F.lit(LANDINGS)) == i)
        part.repartition(files).write.mode("append").parquet(f"{root}/landing={i}")
    return files


def _land_pages(pages, where):
    """Append result pages below their collection's folder; a large collection is cut into several files, a small one is one."""
    pages.select("collection_id", "value").hint("rebalance", "collection_id").write.mode("append").partitionBy("collection_id").text(where)


def _files_per_batch(spark, where):
    """So many files that what lies in a folder comes in LANDINGS micro-batches at most; 20 * FILES at least."""
    return max(20 * FILES, -(-len(spark.read.text(where).inputFiles()) // LANDINGS))


def stream_ingest(spark, d):
    it = S.items(spark, d)
    rec = lambda title: F.to_json(F.struct(F.struct(
        F.col("id"), F.col("url"), F.col("date"), title.alias("title"),
        F.col("languages").alias("language")).alias("item"),
        F.array().cast("array<string>").alias("resources")))
    landing = scratch_path(spark, "landing-items")
    # First landing: drafts of half the items; second: every item, final.
    it.filter(F.col("id").endswith("0") | F.col("id").endswith("2") | F.col("id").endswith("4")) \
        .select(rec(F.concat(F.col("title"), F.lit(" (draft)"))).alias("value")).write.text(f"{landing}/b=1")
    it.select(rec(F.col("title")).alias("value")).write.text(f"{landing}/b=2")
    table = scratch_path(spark, "items-table")
    RN.run(RN.ingest_items(spark, landing, table, scratch_path(spark, "ckpt"), files_per_batch=FILES))
    return RN.current_items(spark, table)["items"].select("id", "title", "year")


def dead_letters(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    iid = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    job = R.uuid_of(iid, F.lit("language"))
    msg = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("not json "), iid)) \
        .when(F.col("doc_id") % 19 == 0, F.to_json(F.struct(job.alias("job_id"), F.col("text").alias("full_text")))) \
        .otherwise(F.to_json(F.struct(job.alias("job_id"), iid.alias("item_id"), F.col("text").alias("full_text"))))
    landing = scratch_path(spark, "landing-messages")
    docs.select(msg.alias("value")).write.text(landing)
    good, dead = scratch_path(spark, "messages"), scratch_path(spark, "dead")
    RN.run(RN.route_messages(spark, landing, good, dead, scratch_path(spark, "ckpt")))
    return spark.read.parquet(dead).select("reason", "key")


def stream_languages(spark, d):
    mixed = S.mixed_items(spark, d).select("item_id", "page_seq", "text")
    landing = scratch_path(spark, "landing-pages")
    files = _land_parquet(mixed, landing, "item_id")
    results = scratch_path(spark, "languages")
    RN.run(RN.detect_languages(spark, landing, mixed.schema, QL.profiles(spark, d), results,
                               scratch_path(spark, "ckpt"), files_per_batch=files))
    return RN.language_results(spark, results).select("item_id", "lang", "sentences")


def stream_quotations(spark, d):
    pages = S.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"), F.lit(0).alias("page_seq"), "text")
    landing = scratch_path(spark, "landing-docs")
    files = _land_parquet(pages, landing, "item_id")
    corpus = Q.ReferenceCorpus.build(S.verses(spark, d), QUOTATION_PARAMS)
    results = scratch_path(spark, "quotations")
    RN.run(RN.detect_quotations(spark, landing, pages.schema, corpus, results, scratch_path(spark, "ckpt"), files_per_batch=files))
    return RN.quotation_results(spark, results, corpus).withColumn("probability", F.round("probability", 6))


class _Lost(Exception):
    """Stands for the loss of a driver inside an epoch, before it was committed."""


def stream_once(spark, d):
    """Words per page, each page processed once: every page lands twice, the
    stream is restarted between the landings, and one epoch is replayed."""
    pages = S.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"), F.lit(0).alias("page_seq"), "text")
    landing, results, checkpoint = (scratch_path(spark, x) for x in ("landing-once", "once", "ckpt"))
    lost = []

    def stream():
        return spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(landing)

    def words(df):
        return df.select("item_id", "page_seq", F.size(word_tokens("text")).cast("long").alias("n_words"))

    def start():
        return K.process_once(stream(), ["item_id", "page_seq"], words, results, checkpoint)

    def dies_once(df):
        out = words(df)
        if not lost and df.limit(1).count():
            lost.append(True)
            raise _Lost()
        return out

    files = _land_parquet(pages, f"{landing}/first=1", "item_id")
    dying = K.process_once(stream(), ["item_id", "page_seq"], dies_once, results, checkpoint)
    try:
        dying.awaitTermination()
    except StreamingQueryException:
        pass
    RN.run(start())
    _land_parquet(pages, f"{landing}/first=2", F.reverse("item_id"))  # the copies come in another order
    RN.run(start())
    return spark.read.parquet(results).select("item_id", "page_seq", "n_words")


def stream_collections(spark, d):
    """Links and stub items of collections whose listings land before, after
    and again beside their result pages."""
    entries = S.items_in_collections(spark, d).join(S.items(spark, d).select(F.col("id").alias("item_id"), "url"), "item_id")
    number = F.floor(F.regexp_extract("item_id", r"(\d+)$", 1).cast("long") / PAGE_ITEMS).cast("int")
    page = F.struct(F.lit("page").alias("title"), F.struct(F.col("number").alias("current")).alias("pagination"), F.col("results"))
    pages = entries.groupBy("collection_id", number.alias("number")).agg(F.collect_list(F.struct(F.col("item_id").alias("id"), "url")).alias("results"))
    pages = pages.select("collection_id", "number", F.to_json(page).alias("value"))
    listing = S.collections(spark, d).select("id", F.to_json(F.struct(F.array(F.struct("id", "title", "count")).alias("results"))).alias("value"))
    early = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    at = {x: scratch_path(spark, x) for x in ("listings", "result-pages", "collections", "ckpt")}

    def land(rows, where):
        rows.select("value").write.mode("append").text(where)

    def ingest():
        files = max(_files_per_batch(spark, at[x]) for x in ("listings", "result-pages"))
        for q in K.ingest_collections(spark, at["listings"], at["result-pages"], at["collections"], at["ckpt"], files_per_batch=files):
            RN.run(q)

    land(listing.filter(early), at["listings"])
    _land_pages(pages.filter("number % 2 = 0"), at["result-pages"])
    ingest()
    _land_pages(pages, at["result-pages"])
    land(listing, at["listings"])
    ingest()
    out = K.ingested(spark, at["collections"])
    stubs = out["items"].select(F.col("id").alias("item_id"), "url")
    titles = out["collections"].select(F.col("id").alias("collection_id"), F.col("title").alias("collection"))
    return out["links"].join(stubs, "item_id", "full").join(titles, "collection_id", "full")


def stream_backlog(spark, d):
    """What may be fetched at three times: when all items are known, at the
    latest event, and when the last cool-down has passed."""
    items, failures = S.items(spark, d), S.failures(spark, d)
    now = S.events_now(spark, d).first()["now"]
    found = items.filter(F.col("api").isNull()).select("id", "url", F.lit("found").alias("kind"), F.lit(datetime.datetime(2000, 1, 1)).alias("at"))
    failed = failures.select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("url"), F.lit("failed").alias("kind"), F.col("failed_at").cast("timestamp").alias("at"))
    landing, results, checkpoint = (scratch_path(spark, x) for x in ("landing-backlog", "backlog", "ckpt"))
    schema = found.schema
    out = None
    for i, (rows, clock) in enumerate(((found, None), (failed, now), (None, now + datetime.timedelta(minutes=61)))):
        if rows is not None:
            rows.write.parquet(f"{landing}/step={i}-a")
        if clock is not None:
            spark.createDataFrame([("", None, "clock", clock)], schema).write.parquet(f"{landing}/step={i}-b")
        events = spark.readStream.schema(schema).parquet(landing).select("id", "url", "kind", "at")
        RN.run(K.watch_backlog(events, results, checkpoint))
        part = cut_lineage(K.backlog(spark, results).select(F.lit(i).alias("step"), "id"))
        out = part if out is None else out.unionByName(part)
    return out


def processor_run(spark, d):
    conv = S.table(spark, d, "conversations")
    iid = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    items = conv.select(iid.alias("id")).distinct().withColumn("api", F.lit("{}"))
    files = conv.select(iid.alias("item_id"), F.col("turn").cast("int").alias("resource_seq"),
                        F.lit(0).alias("file_seq"), F.lit(0).alias("format_seq"),
                        F.lit("text/plain").alias("mimetype"), F.col("text").alias("fulltext"))
    jobs = spark.createDataFrame([], "id string, item_id string, destination string, started timestamp, "
                                     "finished timestamp, status string")
    out = P.run_processor("word_counts", items, jobs, files, F.current_timestamp())
    return out.results.select("item_id", F.col("n_words").cast("long").alias("n_words"), "n_pages")


#: Penalty of squared coefficients: a verse's features may tell the labels apart without error.
FIT_REG = 1e-4
FIT_COLUMNS = ("intercept", "b_tokens", "b_tfidf", "b_proportion", "m_tokens", "m_tfidf", "m_proportion", "s_tokens", "s_tfidf", "s_proportion")


def fit_classifier(spark, d):
    """Fit the match model on document x verse pairs labelled by whether the
    verse text occurs verbatim in the document."""
    docs = S.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"), "text")
    verses = S.verses(spark, d)
    corpus = Q.ReferenceCorpus.build(verses, QUOTATION_PARAMS)
    labelled = Q.label_pairs(cut_lineage(Q.potential_matches(docs, corpus)), docs, verses)
    pairs = cut_lineage(labelled.select("tokens", "tfidf", "proportion", "label"))
    m = Q.fit_match_model(pairs, reg=FIT_REG)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("label").alias("n_positive")).select(
        *[F.round(F.lit(v), 6).alias(n) for n, v in zip(FIT_COLUMNS, (m.intercept, *m.coefficients, *m.means, *m.scales))], "n_pairs", "n_positive")


QUERIES = {
    "stream_ingest": stream_ingest, "dead_letters": dead_letters, "stream_languages": stream_languages,
    "stream_once": stream_once, "stream_collections": stream_collections, "stream_backlog": stream_backlog,
    "stream_quotations": stream_quotations, "processor_run": processor_run, "fit_classifier": fit_classifier,
}


def sql() -> dict[str, str]:
    from ..sources.standins import with_ctes
    from .q_language import _mixed_counts_sql
    return {
        "stream_ingest": with_ctes(["items"], "SELECT id, title, year FROM items"),
        "dead_letters": f"""
          SELECT CASE WHEN doc_id % 17 = 0 THEN 'malformed' ELSE 'missing key' END AS reason,
                 CASE WHEN doc_id % 17 = 0 THEN 'not json doc/' || doc_id
                      ELSE {QS.uuid_sql("'doc/' || doc_id || ':language'")} END AS key
          FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0""",
        "stream_languages": f"WITH {_mixed_counts_sql()} SELECT item_id, lang, sentences FROM counts",
        "stream_quotations": QS.find_quotations_sql(QUOTATION_PARAMS),
        "stream_once": f"""
          SELECT 'doc/' || doc_id AS item_id, 0 AS page_seq, len({QS.WORDS.format(t='text')})::BIGINT AS n_words FROM documents""",
        "stream_collections": with_ctes(["items", "items_in_collections", "collections"], """
          SELECT l.item_id, coalesce(l.collection_id, c.id) AS collection_id, i.url, c.title AS collection
          FROM items_in_collections l JOIN items i ON i.id = l.item_id FULL JOIN collections c ON c.id = l.collection_id"""),
        "stream_backlog": with_ctes(["items", "failures"], """
          SELECT step, i.id FROM items i LEFT JOIN failures f ON f.item_id = i.id, (SELECT unnest([0, 1, 2]) AS step)
          WHERE i.api IS NULL AND strpos(i.url, '/resource/') = 0 AND (step = 0 OR f.failed_at IS NULL
            OR f.failed_at <= (SELECT max(ts) FROM events) + CASE WHEN step = 2 THEN INTERVAL 61 MINUTE ELSE INTERVAL 0 MINUTE END - INTERVAL 60 MINUTE)"""),
        "processor_run": f"""
          SELECT 'conv/' || conv_id AS item_id,
                 CAST(sum(len({QS.WORDS.format(t='text')})) AS BIGINT) AS n_words, count(*) AS n_pages
          FROM conversations GROUP BY conv_id""",
        "fit_classifier": QS.fit_sql(QUOTATION_PARAMS, FIT_REG, FIT_COLUMNS),
    }
