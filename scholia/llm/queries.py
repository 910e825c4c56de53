"""Registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from . import collocations, decontaminate, jaccard, mixing, quality, repair, secret_scan, superminhash, tokens, topk, urls, warc, wrappers

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
SCORE_LIMIT = 0.7
NEIGHBOURS = 5
QUERY_STEP = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), f"{ensure_checkpoint_dir(spark)}/token-cache", drops_blanks=True)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=SCORE_LIMIT)
    return out.select("doc_id", (~quality.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.archived_pages(spark, path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.col("spans_sha256").alias("base_sha256"), "spans")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_jaccard": op8_jaccard,
    "op9_html_text": op9_html_text,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_near_duplicates": op12_near_duplicates,
    "op13_conversation_repair": op13_conversation_repair,
}

OP2_SQL = rf"""
WITH rule(verdict, host, path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT page_id, host, path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rule r
   WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule FROM part p)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.verdict, 'allow') AS verdict
FROM judged j LEFT JOIN rule r ON j.rule = r.host || r.path
"""

OP5_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {NEIGHBOURS}
"""

OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p GROUP BY body),
d AS (SELECT body, first_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('{warc.BASE32}', (1 + ((('0x' || substr(hex, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN d USING (body)
"""


def _components_sql(percent: int, more: str = "") -> str:
    """Components of documents linked at ``percent`` on sets of 4-word shingles."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS MATERIALIZED (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM c),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id{more}
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON k.a = c.doc_id
"""


OP8_SQL = _components_sql(85)
OP12_SQL = _components_sql(80, ", coalesce(k.component_id, s.doc_id) IS NOT DISTINCT FROM s.doc_id AS kept")



OP11_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score,
             row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * a // (x.f + y.f), cut) AS place
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[b:b + m - 1], ' ') AS phrase
      FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS b) WHERE m < k AND b + m - 1 <= k) GROUP BY lang, phrase),
k AS (SELECT s.lang, s.phrase, a, l, r, score FROM s LEFT JOIN i ON s.lang = i.lang AND s.phrase = i.phrase WHERE place = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON q.lang = n.lang WHERE rank <= 2000
"""


def _repair_sql() -> str:
    """Damage, faults and the audit DP, whose states e, s, u and a hold cost c, letters p and repaired lines t."""
    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, p := {state}.p || '{letter}', t := {state}.t || {line}) END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    user, assistant, own = "'user:' || chr(10)", "'assistant:' || chr(10)", "role || ':' || text || chr(10)"
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)")
    put_in = f"""SELECT * REPLACE ({least('a', step('u', '3', 'I', assistant))} AS a) FROM (SELECT * REPLACE (
        {least('u', step('e', '3', 'I', user), step('s', '3', 'I', user), step('a', '3', 'I', user))} AS u) FROM"""

    def kept(initial: str, *states: str) -> list[str]:
        return [f"CASE WHEN NOT bad AND initial = '{initial}' THEN {step(x, 'more', 'K', own)} END" for x in states]

    def rerolled(role: str, *states: str) -> list[str]:
        line = f"'{role}:' || text || chr(10)"
        return [f"CASE WHEN NOT bad THEN {step(x, '3 + more', 'R', line)} END" for x in states]

    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT *, {crc} % 20 AS fault FROM k),
m AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m),
f AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?', '') AS cut_off FROM n),
g AS MATERIALIZED (SELECT conv_id, i, role, text, initial, blank OR again AS bad, CASE WHEN cut_off AND NOT blank AND NOT again THEN 3 ELSE 0 END AS more, turn, blank, again AND NOT blank AS duplicate,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM f),
o AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
             count(*) FILTER (duplicate)::BIGINT AS duplicate, count(*) FILTER (more > 0)::BIGINT AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM g GROUP BY conv_id),
r AS (
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, p := '', t := '') AS e, NULL::STRUCT(c BIGINT, p VARCHAR, t VARCHAR) AS s,
         NULL::STRUCT(c BIGINT, p VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, p VARCHAR, t VARCHAR) AS a FROM o
  UNION ALL
  SELECT conv_id, i, {step('e', '4', 'D')}, {least(step('s', '4', 'D'), *kept('s', 'e'))},
         {least(step('u', '4', 'D'), *kept('u', 'e', 's', 'a'), *rerolled('user', 'e', 's', 'a'))},
         {least(step('a', '4', 'D'), *kept('a', 'u'), *rerolled('assistant', 'u'))}
  FROM ({put_in} (SELECT r.conv_id, g.i, e, s, u, a, role, text, initial, bad, more FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = r.i + 1)))),
l AS (SELECT conv_id, {least('e', 'a')} AS b FROM ({put_in} (SELECT * FROM r WHERE i = (SELECT max(i) FROM g WHERE g.conv_id IS NOT DISTINCT FROM r.conv_id))))),
x AS (SELECT DISTINCT conv_id FROM conversations)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.p, '') AS audit, sha256(coalesce(left(b.t, length(b.t) - 1), '')) AS repaired_sha256
FROM x LEFT JOIN o ON x.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN l ON x.conv_id IS NOT DISTINCT FROM l.conv_id
"""


SQL = {"op2_url_filter": OP2_SQL, "op5_top_k": OP5_SQL, "op6_warc": OP6_SQL, "op8_jaccard": OP8_SQL, "op11_collocations": OP11_SQL, "op12_near_duplicates": OP12_SQL, "op13_conversation_repair": _repair_sql()}
