"""Oracle SQL (DuckDB dialect) for the registered queries."""

from __future__ import annotations

from . import quotation_sql as QS
from . import q_io, q_language, q_sinks, q_stream, q_tables
from .catalog import QUOTATION_PARAMS, TOP_K


def oracle() -> dict[str, str]:
    p = QUOTATION_PARAMS
    return {
        "find_quotations": QS.find_quotations_sql(p),
        "potential_matches": QS.potential_matches_sql(p),
        "top_matches": QS.top_matches_sql(p, TOP_K),
        "match_statistics": QS.match_statistics_sql(p),
        "verse_weights": QS.verse_weights_sql(p),
        "page_quotations_to_item": QS.page_quotations_sql(p),
        **q_tables.sql(),
        **q_io.sql(),
        **q_language.sql(),
        **q_stream.sql(),
        **q_sinks.sql(),
    }
