"""Record-level helpers: blanks, JSON, ids, URLs, fixed lookup values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Job statuses in the order of the status enum.
JOB_STATUSES = ["ready", "running", "skipped", "failed", "finished"]

# Declared language names and two-letter tags mapped to the
# upper-case ISO 639-3 codes the detector reports.
LANGUAGE_NAMES = {"english": "ENG", "french": "FRA", "german": "DEU", "spanish": "SPA"}
LANGUAGE_TAGS = {"en": "ENG", "fr": "FRA", "de": "DEU", "es": "SPA"}
TAG_NAMES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}

# Request parameters of the listing and item APIs.
# The API base is configuration: pass ``base=`` to has_api, or change this default.
API_BASE = "https://api.example.org"
ITEM_BLOCKS = ["more_like_this", "related_items", "cite_this", "options"]
LISTING_BLOCKS = [
    "aka", "breadcrumbs", "browse", "categories", "content", "content_is_post",
    "expert_resources", "facet_trail", "facet_views", "facets", "featured_items",
    "form_facets", "legacy-url", "next", "next_sibling", "options",
    "original_formats", "pages", "partof", "previous", "previous_sibling",
    "research-centers", "shards", "site_type", "subjects", "timeline_1852_1880",
    "timeline_1881_1900", "timeline_1901_1925", "timestamp", "topics", "views",
]
ONLINE_TEXT_FACET = "online-format:online text"
# Query strings are form-encoded with keys in sorted order.
ITEM_QUERY = "at%21=" + "%2C".join(ITEM_BLOCKS) + "&fo=json"
PAGE_QUERY = ("at%21=" + "%2C".join(LISTING_BLOCKS) + "&c={per_page}"
              "&fa=online-format%3Aonline+text&fo=json&sp={page}&st=list")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(""))


def first_or_blank(col) -> Column:
    """First element of an array, ``''`` when absent."""
    return F.coalesce(F.get(_c(col), 0), F.lit(""))


def record_json(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def json_path(col, path: str, variant: bool = False, as_type: str = "string") -> Column:
    """Value at a JSON path of a JSON text column (NULL when absent or not JSON).

    ``variant=True`` parses into Spark's VARIANT type and reads the path
    with ``try_variant_get`` (typed as ``as_type``); otherwise
    ``get_json_object`` returns the text at the path.
    """
    if variant:
        return F.try_variant_get(F.try_parse_json(_c(col)), path, as_type)
    return F.get_json_object(_c(col), path)


def status_rank(col) -> Column:
    """Position of a job status in enum order (1-based, 0 when unknown)."""
    return F.array_position(F.array(*[F.lit(s) for s in JOB_STATUSES]), _c(col)).cast("int")


def uuid_of(*cols) -> Column:
    """Deterministic uuid-shaped id: md5 of the parts joined by ':'."""
    h = F.md5(F.concat_ws(":", *[_c(c).cast("string") for c in cols]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def is_uuid(col) -> Column:
    return _c(col).rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def map_lookup(col, mapping: dict) -> Column:
    """Look a value up in a fixed, literal mapping (NULL when absent)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(col))


def has_api(col, base: str = API_BASE) -> Column:
    return _c(col).startswith(base)


def is_resource(col) -> Column:
    return F.instr(_c(col), "/resource/") > 0


def item_fetch_url(col) -> Column:
    """Item URL without its query, with the JSON format and blocks removed."""
    return F.concat(F.regexp_replace(_c(col), r"[?#].*$", ""), F.lit("?" + ITEM_QUERY))


def collection_page_url(items_url, page, per_page: int = 1000) -> Column:
    base = F.regexp_replace(_c(items_url), r"[?#].*$", "")
    q = PAGE_QUERY.split("{page}")
    return F.concat(base, F.lit("?" + q[0].format(per_page=per_page)), _c(page).cast("string"), F.lit(q[1]))
