"""Readers for the JSON and CSV inputs (explicit schemas, nothing inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import blank_to_null, first_or_blank, record_json
from ..session import cut_lineage
from . import schemas as SC


def read_collections(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Collections listing files ``{"results": [collection, ...]}`` -> rows of
    the ``collections`` table (first description, raw record as ``api``).

    ``multiline=True`` reads one (pretty-printed) listing per file;
    ``False`` reads one listing per line, which splits across tasks."""
    return collection_rows(spark.read.schema(SC.COLLECTIONS_LISTING).option("multiLine", multiline).json(path))


def collection_rows(listings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``collections`` (and the columns in ``keep``) of listings."""
    c = listings.select(F.explode("results").alias("c"), *(keep or [])).select("c.*", *(keep or []))
    return c.select(
        "id", "title", first_or_blank(F.col("description")).alias("description"), "count", "url",
        F.col("items").alias("items_url"), F.col("subject").alias("subjects"),
        F.col("item.subjects").alias("subjects2"), F.col("subject_topic").alias("topics"),
record_json(*SC.COLLECTION.fieldNames()).alias("api"), *(keep or []))


def read_collection_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Result pages of collections -> (collection_id, title, page, item_id, url).

    Pages are landed under ``<path>/collection_id=<id>/``; the collection id
    comes from that folder (partition discovery), as the request context
    supplies it in a crawler.
    """
    schema = SC.COLLECTION_PAGE.add("collection_id", "string")
    return page_entries(spark.read.schema(schema).option("multiLine", multiline).json(path))


def page_entries(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per entry of result pages (with the columns in ``keep``)."""
    return pages.select("collection_id", "title", F.col("pagination.current").alias("page"),
                        F.explode("results").alias("r"), *(keep or [])) \
        .select("collection_id", "title", "page", F.col("r.id").alias("item_id"), F.col("r.url").alias("url"), *(keep or []))


def read_item_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Item record files -> (api, record, id).

    One JSON record per line, or with ``multiline=True`` one (pretty-printed)
    record per file, as an API response is saved.  ``api`` keeps the raw
    JSON text; ``record`` is the typed parse; ``id`` is the id carried by
    the record (it may differ from the stub's id).
    """
    raw = spark.read.text(path, wholetext=multiline).withColumnRenamed("value", "api") \
        .filter(F.trim("api") != "")
    rec = raw.withColumn("record", F.from_json("api", SC.ITEM_RECORD))
    return rec.select("api", "record", F.col("record.item.id").alias("id"))


def item_rows(records: DataFrame, now, keep: list[str] = ()) -> DataFrame:
    """Parsed item records -> rows of the ``items`` table (title/url/date kept
    as given; ``year`` from the date; ``updated`` = now).  ``keep`` names
    extra input columns carried along."""
    from ..functions.dates import year_of
    d = records.select("api", "record.item.*", *keep)
    return d.select("id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
                    year_of(F.col("date")).alias("year"), F.coalesce("date", F.lit("")).alias("date"),
                    F.col("subject_headings").alias("subjects"), F.col("language").alias("languages"),
                    "api", (F.lit(now).cast("timestamp") if isinstance(now, str) else now).alias("updated"),
                    *keep)


def read_books(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Book export files (named like ``pattern``) -> (books, rejects).

    Any concatenation of objects is read: one a line, several a line, or
    spread over lines.  Files split across tasks by lines, and a line that
    holds whole objects needs nothing else.  Only files with some other line
    are read a second time, each in one task that takes its lines in order
    and holds one open object at a time.  What does not parse goes
    to ``rejects`` with its text; the rest of the file is still read.
    ``_file`` and ``_seq`` give the order of the load.
    """
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # File and read position are taken right after the read, so "first in
    # the load" (file order, then line order) can be decided later.
    lines = (spark.read.option("pathGlobFilter", pattern).text(path)
             .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_line"), "value")
             .filter(F.trim("value") != ""))
    pieces = cut_lineage(lines.mapInPandas(_line_splitter(), "_file string, _block long, _line long, _part long, json string, whole boolean"))
    open_files = pieces.filter(~F.col("whole")).select("_file").distinct()
    again = lines.join(open_files, "_file", "left_semi").repartition("_file") \
        .sortWithinPartitions("_file", "_block", "_line") \
        .mapInPandas(_line_joiner(), "_file string, _block long, _line long, _part long, json string")
    objs = pieces.join(open_files, "_file", "left_anti").drop("whole").unionByName(again) \
        .withColumn("_seq", F.struct("_block", "_line", "_part"))
    parsed = objs.withColumn("b", F.from_json("json", SC.BOOK, opts))
    raw = parsed.select("b.*", "_file", "_seq", "json")
    bad_flag = F.col("_corrupt_record").isNotNull() | (F.col("lccn").isNull() & F.col("title").isNull())
    good = raw.filter(~bad_flag).drop("_corrupt_record", "json")
    bad = raw.filter(bad_flag).select("_file", "lccn", F.col("json").alias("record"))
    return good, bad


def _line_splitter():
    """mapInPandas body: a line -> its JSON objects, or the line itself with
    ``whole`` false where it is no plain sequence of objects.  (A function
    made here is shipped by value: workers need no package path.)"""
    def split(batches):
        import json

        import pandas as pd
        dec = json.JSONDecoder()
        for pdf in batches:
            rows = []
            for f, block, line, text in zip(pdf["_file"], pdf["_block"], pdf["_line"], pdf["value"]):
                text, found, i = text.strip(), [], 0
                try:
                    while i < len(text):
                        obj, end = dec.raw_decode(text, i)
                        if not isinstance(obj, dict):
                            raise ValueError
                        found.append(text[i:end])
                        i = end + len(text[end:]) - len(text[end:].lstrip())
                    rows += [(f, block, line, k, t, True) for k, t in enumerate(found)]
                except ValueError:
                    rows.append((f, block, line, 0, text, False))
            yield pd.DataFrame(rows, columns=["_file", "_block", "_line", "_part", "json", "whole"])
    return split


def _line_joiner():
    """mapInPandas body over a file's lines in order: objects that span lines.

    An object ends where its braces close outside strings (a JSON string
    cannot span lines).  A fault makes one reject of the text from it to the
    end of the line or of the open object; a line that begins with ``{``
    without indent ends an open object, which is then a reject."""
    def join(batches):
        import json
        import re

        import pandas as pd
        dec = json.JSONDecoder()
        mark = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]')
        name, text, at, depth = None, [], None, 0      # the file, the open text, its place, its open braces

        def objects(joined, place, is_open):
            """(rows, rest): the leading objects and, if more lines may follow, the text behind them."""
            rows, i, k = [], 0, place[2]
            while True:
                i = len(joined) - len(joined[i:].lstrip())
                if i >= len(joined):
                    return rows, "", k
                try:
                    _, end = dec.raw_decode(joined, i)
                except ValueError:
                    if is_open:
                        return rows, joined[i:], k
                    end = len(joined)
                rows.append((name, place[0], place[1], k, joined[i:end].strip()))
                i, k = end, k + 1

        def reject():
            return [(name, *at, "\n".join(text).strip())] if text else []

        for pdf in batches:
            rows = []
            for f, block, line, value in zip(pdf["_file"], pdf["_block"], pdf["_line"], pdf["value"]):
                if f != name or (text and value.startswith("{")):
                    rows += reject()
                    name, text, depth = f, [], 0
                if not text:
                    at = (block, line, 0)
                text.append(value)
                low = depth
                for m in mark.findall(value):
                    depth += (m == "{") - (m == "}")
                    low = min(low, depth)
                if low <= 0:
                    found, rest, k = objects("\n".join(text), at, depth > 0)
                    rows += found
                    text, at = [rest] if rest else [], (block, line, k)
                    depth = max(depth, 0)
            yield pd.DataFrame(rows, columns=["_file", "_block", "_line", "_part", "json"])
        yield pd.DataFrame(reject(), columns=["_file", "_block", "_line", "_part", "json"])
    return join


def book_rows(books: DataFrame, now, keep: list[str] = ()) -> DataFrame:
    """Book records -> rows of the ``books`` table (year from the raw date
    JSON, 0 without one; metadata JSON without the text).  ``keep`` carries
    extra columns (e.g. ``_file``, ``_seq`` for first-writer-wins)."""
    from ..functions.dates import book_year
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return books.select(
        "lccn", "isbn", "title", "publisher", book_year(F.col("publication_date")).alias("year"),
        "subject_full", "subject", "person", F.col("language").alias("lang"),
        book_metadata_json(books).alias("original_metadata"), F.col("text_en").alias("text"),
        now_c.alias("created"), now_c.alias("updated"), *keep)


def book_metadata_json(books: DataFrame):
    """The whole record re-encoded as JSON with ``text_en`` blanked."""
    cols = [c for c in books.columns if not c.startswith("_")]
    return F.to_json(F.struct(*[F.lit("").alias(c) if c == "text_en" else F.col(c) for c in cols]))


def read_document_batch(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 3-column CSV (job_id, doc_id, text); quoted newlines allowed."""
    return (spark.read.schema(SC.DOCUMENT_BATCH).option("header", False).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_document_batch(df: DataFrame, path: str) -> None:
    df.select("job_id", "doc_id", "text").write.mode("overwrite").option("header", False) \
        .option("escape", '"').option("quoteAll", True).csv(path)


def read_predictions(spark: SparkSession, path: str, on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Prediction CSV -> (rows, rejects).  A row is rejected when its job id
    is not a uuid or its probability is not a number.  ``on_error='fail'``
    raises if any row is rejected (the reference drops the whole batch)."""
    from ..functions.records import is_uuid
    raw = spark.read.schema(SC.PREDICTIONS).option("header", False).option("escape", '"').csv(path)
    p = F.col("probability").try_cast("double")
    ok = is_uuid(F.col("job_id")) & p.isNotNull()
    good = raw.filter(ok).select("job_id", "item_id", "reference_id", "verse_id", p.alias("probability"))
    bad = raw.filter(~ok | ok.isNull())
    if on_error == "fail" and bad.limit(1).count() > 0:
        raise ValueError("prediction file has malformed rows")
    return good, bad


def write_predictions(df: DataFrame, path: str) -> None:
    """No header; an empty result still produces an (empty) output."""
    df.select("job_id", "item_id", "reference_id", "verse_id", F.col("probability").cast("string")) \
        .write.mode("overwrite").option("header", False).option("escape", '"').csv(path)


def nullify_blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[blank_to_null(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
