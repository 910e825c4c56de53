"""Registered language-detection queries (profiles trained on ``documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import TAG_NAMES, map_lookup
from ..functions.text import ABBREVIATIONS
from ..operators import language as L
from ..sources import standins as S
from ..sources.standins import SQL as STANDIN

MIN_SENTENCES = 2
MIN_SHARE = 0.2


def profiles(spark, d) -> L.Profiles:
    docs = S.table(spark, d, "documents").select("lang", "text")
    return L.Profiles.build(L.train_profiles(docs))


def sentence_languages(spark, d):
    pages = S.table(spark, d, "documents").select("doc_id", "text")
    return L.sentence_languages(pages, profiles(spark, d), keys=["doc_id"])


def _mixed_counts(spark, d):
    mixed = S.mixed_items(spark, d)
    det = L.sentence_languages(mixed, profiles(spark, d), keys=["item_id", "page_seq"])
    return L.language_counts(det, "item_id")


def language_counts(spark, d):
    return _mixed_counts(spark, d)


def multilingual_items(spark, d):
    return L.multilingual_items(_mixed_counts(spark, d), "item_id", MIN_SENTENCES, MIN_SHARE)


def language_agreement(spark, d):
    declared = S.mixed_items(spark, d).groupBy("item_id").agg(
        F.collect_set(F.coalesce(map_lookup(F.col("lang"), TAG_NAMES), F.col("lang"))).alias("languages"))
    return L.language_agreement(_mixed_counts(spark, d), declared, "item_id")


QUERIES = {
    "sentence_languages": sentence_languages, "language_counts": language_counts,
    "multilingual_items": multilingual_items, "language_agreement": language_agreement,
}


# ---------------------------------------------------------------------------
# SQL forms
# ---------------------------------------------------------------------------

CODE_SQL = ("CASE {c} WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRA' WHEN 'de' THEN 'DEU' "
            "WHEN 'es' THEN 'SPA' ELSE {c} END")


def _letters(c: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}]+', ' ', 'g')) || ' ')"


def _char_grams_of(t: str) -> str:
    """Char 3-grams of an already letter-normalised column ``t``."""
    return (f"list_filter(list_transform(generate_series(1, length({t}) - 2), lambda i: substr({t}, i, 3)), "
            f"lambda g: trim(g) <> '')")


def _sentences(c: str) -> str:
    abbrev = ABBREVIATIONS.replace("'", "''")
    t = f"regexp_replace({c}, '{abbrev}', '\\1\\2' || chr(2), 'g')"
    t = f"regexp_replace({t}, '([.!?]+)\\s+', '\\1' || chr(1), 'g')"
    t = f"regexp_replace({t}, '[\\r\\n]+', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({t}, chr(1)), lambda x: trim(replace(x, chr(2), '.'))), "
            f"lambda x: x <> '')")


def profile_ctes() -> str:
    return f"""
tr AS (SELECT {CODE_SQL.format(c='lang')} AS lang, {_letters('text')} AS t FROM documents),
tg AS (SELECT lang, unnest({_char_grams_of('t')}) AS gram FROM tr WHERE lang IS NOT NULL),
top AS (SELECT lang, gram, count(*) AS c FROM tg GROUP BY lang, gram),
tot AS (SELECT lang, sum(c) AS total FROM top GROUP BY lang),
vv AS (SELECT count(DISTINCT gram) AS V FROM top),
unseen AS (SELECT lang, ln(1.0 / CAST(total + V AS DOUBLE)) AS unseen FROM tot, vv),
gains AS (SELECT top.lang, gram, ln((c + 1) / CAST(total + V AS DOUBLE)) - ln(1.0 / CAST(total + V AS DOUBLE)) AS gain
          FROM top JOIN tot ON top.lang = tot.lang, vv)"""


def detect_ctes(pages_sql: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys + ["sentence_seq"])
    ak = ", ".join(f"a.{c}" for c in keys)
    return f"""
pg AS ({pages_sql}),
sl AS (SELECT {k}, {_sentences('text')} AS ss FROM pg),
sents AS (SELECT {k}, CAST(unnest(generate_series(0, len(ss) - 1)) AS INTEGER) AS sentence_seq,
                 unnest(ss) AS sentence FROM sl),
st AS (SELECT {k}, sentence_seq, {_letters('sentence')} AS t FROM sents),
sg AS (SELECT {k}, sentence_seq, unnest({_char_grams_of('t')}) AS gram FROM st),
sn AS (SELECT {k}, sentence_seq, count(*) AS n, count(*) FILTER (WHERE gram IN (SELECT gram FROM gains)) AS known
       FROM sg GROUP BY ALL),
part AS (SELECT {k}, sentence_seq, g.lang, sum(g.gain) AS s FROM sg JOIN gains g USING (gram) GROUP BY ALL),
sc AS (SELECT {ak}, a.sentence_seq, a.known, u.lang, a.n * u.unseen + coalesce(b.s, 0.0) AS score
       FROM sn a CROSS JOIN unseen u LEFT JOIN part b ON {on} AND b.lang = u.lang),
best AS (SELECT {k}, sentence_seq, max(known) AS known, first(lang ORDER BY score DESC, lang ASC) AS lang FROM sc GROUP BY ALL),
det AS (SELECT s.{keys[0]}{''.join(f', s.{c}' for c in keys[1:])}, s.sentence_seq,
               CASE WHEN coalesce(b.known, 0) = 0 THEN 'UND' ELSE b.lang END AS lang
        FROM sents s LEFT JOIN best b ON {' AND '.join(f's.{c} = b.{c}' for c in keys + ['sentence_seq'])})"""


def _mixed_counts_sql() -> str:
    pages = f"SELECT item_id, page_seq, text FROM ({STANDIN['mixed_items']})"
    return f"""{profile_ctes()},
{detect_ctes(pages, ['item_id', 'page_seq'])},
counts AS MATERIALIZED (SELECT item_id, lang, CAST(count(*) AS INTEGER) AS sentences FROM det GROUP BY item_id, lang)"""


def sql() -> dict[str, str]:
    multi = f"""
dd AS (SELECT * FROM counts WHERE lang <> 'UND'),
tt AS (SELECT item_id, sum(sentences) AS total FROM dd GROUP BY item_id),
ok AS (SELECT dd.* FROM dd JOIN tt USING (item_id)
       WHERE sentences >= {MIN_SENTENCES} AND sentences >= CAST({MIN_SHARE!r} AS DOUBLE) * CAST(total AS DOUBLE))"""
    return {
        "sentence_languages": f"""WITH {profile_ctes()},
{detect_ctes('SELECT doc_id, text FROM documents', ['doc_id'])}
SELECT doc_id, sentence_seq, lang FROM det""",
        "language_counts": f"""WITH {_mixed_counts_sql()}
SELECT item_id, lang, sentences FROM counts""",
        "multilingual_items": f"""WITH {_mixed_counts_sql()}, {multi}
SELECT item_id, count(*) AS n_languages, string_agg(lang, ',' ORDER BY lang) AS languages
FROM ok GROUP BY item_id HAVING count(*) >= 2""",
        "language_agreement": f"""WITH {_mixed_counts_sql()},
dom AS (SELECT item_id, first(lang ORDER BY sentences DESC, lang ASC) AS lang FROM counts WHERE lang <> 'UND' GROUP BY item_id),
decl AS (SELECT item_id, list_sort(list_distinct(list({CODE_SQL.format(c='lang')}))) AS codes
         FROM ({STANDIN['mixed_items']}) GROUP BY item_id)
SELECT d.item_id, d.lang AS detected, array_to_string(coalesce(c.codes, []), ',') AS declared,
       coalesce(list_contains(c.codes, d.lang), false) AS agrees
FROM dom d LEFT JOIN decl c ON c.item_id = d.item_id""",
    }
