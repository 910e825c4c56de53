"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or stand-ins Spark derives from
them) over their whole extent.  Output columns are aliased, counts are
BIGINT and doubles are rounded to 6 places so that results can be
compared with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quotations as Q
from ..sources import standins as S

QUOTATION_PARAMS = Q.QuotationParams()
TOP_K = 50


def _docs_as_pages(spark, d) -> DataFrame:
    return S.table(spark, d, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item_id"), "text")


def _corpus(spark, d) -> Q.ReferenceCorpus:
    return Q.ReferenceCorpus.build(S.verses(spark, d), QUOTATION_PARAMS)


def find_quotations(spark: SparkSession, d: str) -> DataFrame:
    out = Q.find_quotations(_docs_as_pages(spark, d), _corpus(spark, d))
    return out.withColumn("probability", F.round("probability", 6))


def potential_matches(spark, d):
    pot = Q.potential_matches(_docs_as_pages(spark, d), _corpus(spark, d))
    return pot.select("item_id", "verse_id", "tokens", F.round("tfidf", 6).alias("tfidf"),
                      F.round("proportion", 6).alias("proportion"))


def top_matches(spark, d):
    return potential_matches(spark, d).orderBy(F.desc("tokens"), "item_id", "verse_id").limit(TOP_K)


def match_statistics(spark, d):
    pot = Q.potential_matches(_docs_as_pages(spark, d), _corpus(spark, d))
    return Q.match_statistics(pot, QUOTATION_PARAMS)


def verse_weights(spark, d):
    c = _corpus(spark, d)
    return c.weights.select("verse_id", "gram", "n_v", F.round("w", 6).alias("w"),
                            "verse_len", "df")


def page_quotations_to_item(spark, d):
    out = Q.page_quotations_to_item(S.doc_pages(spark, d), _corpus(spark, d))
    return out.withColumn("probability", F.round("probability", 6))


QUOTATION_QUERIES = {
    "find_quotations": find_quotations,
    "potential_matches": potential_matches,
    "top_matches": top_matches,
    "match_statistics": match_statistics,
    "verse_weights": verse_weights,
    "page_quotations_to_item": page_quotations_to_item,
}


from . import q_io, q_language, q_sinks, q_stream, q_tables  # noqa: E402

QUERIES = {**QUOTATION_QUERIES, **q_tables.QUERIES, **q_io.QUERIES, **q_language.QUERIES, **q_stream.QUERIES, **q_sinks.QUERIES}
