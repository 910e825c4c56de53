"""Declared schemas: final tables and the JSON inputs (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampType()
ARR = T.ArrayType(T.StringType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- JSON inputs -----------------------------------------------------------

# The fields of a collection record, by type (ANY: any JSON shape is kept).
ANY = T.ArrayType(T.VariantType())
COLLECTION_DETAILS = _st(
    *[(n, S) for n in ("date", "title")],
    *[(n, ARR) for n in ("access_advisory", "contributors", "format", "language", "location", "medium", "notes",
                         "repository", "subjects", "summary")])
COLLECTION = _st(
    *[(n, S) for n in ("extract_timestamp", "id", "items", "shelf_id", "timestamp", "title", "url")],
    *[(n, I) for n in ("count", "index")],
    *[(n, B) for n in ("digitized", "hassegments")],
    *[(n, ARR) for n in ("contributor", "dates", "description", "group", "image_url", "language", "location", "number",
                         "number_lccn", "number_source_modified", "original_format", "partof", "subject", "subject_topic")],
    *[(n, ANY) for n in ("other_title", "resources")],
    ("item", COLLECTION_DETAILS))
COLLECTIONS_LISTING = _st(("results", T.ArrayType(COLLECTION)))

COLLECTION_PAGE = _st(("title", S), ("pagination", _st(("current", I), ("next", S))),
                      ("results", T.ArrayType(_st(("id", S), ("url", S)))))

FILE_FORMAT = _st(("mimetype", S), ("fulltext", S), ("fulltext_service", S), ("word_coordinates", S),
                  ("url", S), ("info", S), ("use", S))
RESOURCE = _st(("fulltext_file", S), ("djvu_text_file", S), ("image", S), ("pdf", S), ("url", S),
               ("caption", S), ("files", T.ArrayType(T.ArrayType(FILE_FORMAT))))
ITEM_DETAILS = _st(("id", S), ("url", S), ("date", S), ("subject_headings", ARR), ("title", S),
                   ("language", ARR))
ITEM_RECORD = _st(("item", ITEM_DETAILS), ("resources", T.ArrayType(RESOURCE)))

# Book exports keep publication_date as raw JSON text (any JSON shape).
BOOK = _st(("lccn", S), ("isbn", ARR), ("title", S), ("publisher", S), ("publication_date", S),
           ("subject_full", ARR), ("subject", ARR), ("person", ARR), ("language", ARR), ("text_en", S),
           ("_corrupt_record", S))

MESSAGE = _st(("job_id", S), ("item_id", S), ("full_text", S), ("_corrupt_record", S))

# --- CSV hand-over files ---------------------------------------------------

DOCUMENT_BATCH = "job_id string, doc_id string, text string"
PREDICTIONS = "job_id string, item_id string, reference_id string, verse_id string, probability string"

# --- Final tables ----------------------------------------------------------

COLLECTIONS = _st(("id", S), ("title", S), ("description", S), ("count", I), ("url", S), ("items_url", S),
                  ("subjects", ARR), ("subjects2", ARR), ("topics", ARR), ("api", S))
ITEMS = _st(("id", S), ("url", S), ("title", S), ("year", I), ("date", S), ("subjects", ARR),
            ("languages", ARR), ("api", S), ("updated", TS))
ITEMS_IN_COLLECTIONS = _st(("item_id", S), ("collection_id", S))
RESOURCES = _st(("item_id", S), ("resource_seq", I), ("fulltext_file", S), ("djvu_text_file", S),
                ("image", S), ("pdf", S), ("url", S), ("caption", S))
FILES = _st(("item_id", S), ("resource_seq", I), ("file_seq", I), ("format_seq", I), ("mimetype", S),
            ("fulltext", S), ("fulltext_service", S), ("word_coordinates", S), ("url", S), ("info", S),
            ("use", S))
BOOKS = _st(("lccn", S), ("isbn", ARR), ("title", S), ("publisher", S), ("year", I), ("subject_full", ARR),
            ("subject", ARR), ("person", ARR), ("lang", ARR), ("original_metadata", S), ("text", S),
            ("created", TS), ("updated", TS))
JOBS = _st(("id", S), ("item_id", S), ("destination", S), ("started", TS), ("finished", TS), ("status", S))
QUOTATIONS = _st(("job_id", S), ("item_id", S), ("reference_id", S), ("verse_id", S),
                 ("probability", T.FloatType()))
LANGUAGES = _st(("job_id", S), ("item_id", S), ("lang", S), ("sentences", I))
