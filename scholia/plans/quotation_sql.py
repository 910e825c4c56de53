"""SQL (DuckDB dialect) statements of the quotation family, for the oracle.

Same definitions as :mod:`scholia.operators.quotations`, written as plain
SQL over the pre-registered tables.
"""

from __future__ import annotations

from ..operators.quotations import MAX_STEP, MatchModel, QuotationParams
from ..sources.standins import SQL as STANDIN

WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def grams_sql(w: str, n: int) -> str:
    """n-grams of a word-list column ``w`` (compute the list in a subquery first)."""
    return (f"CASE WHEN len({w}) >= {n} THEN list_transform(generate_series(1, len({w}) - {n - 1}), "
            f"lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' ')) ELSE [] END")


def prob_sql(m: MatchModel) -> str:
    terms = " + ".join(f"({b!r}) * (({f} - ({mu!r})) / ({s!r}))"
                       for f, b, mu, s in zip(("tokens", "tfidf", "proportion"), m.coefficients, m.means, m.scales))
    return f"1.0 / (1.0 + exp(-(({m.intercept!r}) + {terms})))"


def base_ctes(p: QuotationParams, pages_sql: str, keys: list[str]) -> str:
    """CTEs: verses, vg (verse grams), vw (weights), pg (page grams), pm (potential)."""
    k = ", ".join(keys)
    dk = ", ".join(f"d.{c}" for c in keys)
    idf = "ln(N / (df + 1))" if p.idf == "smooth_denominator" else "ln(1 + N / df)"
    return f"""
verses AS ({STANDIN['verses']}),
vg AS (SELECT verse_id, gram, count(*) AS n_v FROM (
         SELECT verse_id, unnest({grams_sql('w', p.n)}) AS gram
         FROM (SELECT verse_id, {WORDS.format(t='text')} AS w FROM verses)) GROUP BY verse_id, gram),
nv AS (SELECT CAST(count(DISTINCT verse_id) AS DOUBLE) AS N FROM verses),
vw0 AS (SELECT verse_id, gram, n_v,
               sum(n_v) OVER (PARTITION BY verse_id) AS verse_len,
               count(*) OVER (PARTITION BY gram) AS df
        FROM vg),
vw AS (SELECT verse_id, gram, n_v, verse_len, df, n_v / verse_len * {idf} AS w FROM vw0, nv),
pages_in AS ({pages_sql}),
pg AS (SELECT {k}, gram, count(*) AS n_d FROM (
         SELECT {k}, unnest({grams_sql('w', p.n)}) AS gram
         FROM (SELECT {k}, {WORDS.format(t='text')} AS w FROM pages_in))
       WHERE gram IN (SELECT gram FROM vw) GROUP BY {k}, gram),
pm AS (SELECT {dk}, v.verse_id, CAST(sum(v.n_v * d.n_d) AS BIGINT) AS tokens,
              sum(v.w * d.n_d) AS tfidf, sum(v.n_v * d.n_d) / max(v.verse_len) AS proportion
       FROM pg d JOIN vw v ON d.gram = v.gram GROUP BY {dk}, v.verse_id)"""


def scored_ctes(p: QuotationParams) -> str:
    return f"""
kept AS (SELECT *, {prob_sql(p.model)} AS probability FROM pm
         WHERE tokens >= {p.min_tokens!r} OR tfidf >= {p.min_tfidf!r}),
acc AS (SELECT *, regexp_replace(verse_id, ' \\(.+\\)', '') AS reference_id,
               CASE WHEN strpos(verse_id, '{p.preferred_label}') > 0 THEN probability + {p.bonus!r}
                    ELSE probability END AS prob_adj
        FROM kept WHERE probability >= {p.min_probability!r})"""


def documents_pages_sql() -> str:
    return "SELECT 'doc/' || doc_id AS item_id, text FROM documents"


def uuid_sql(expr: str) -> str:
    h = f"md5({expr})"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


def find_quotations_sql(p: QuotationParams) -> str:
    return f"""WITH {base_ctes(p, documents_pages_sql(), ['item_id'])},
{scored_ctes(p)},
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, reference_id
                                     ORDER BY prob_adj DESC, verse_id ASC) AS rn FROM acc)
SELECT {uuid_sql("item_id || ':quotations'")} AS job_id, item_id, reference_id, verse_id,
       round(probability, 6) AS probability
FROM best WHERE rn = 1"""


def potential_matches_sql(p: QuotationParams) -> str:
    return f"""WITH {base_ctes(p, documents_pages_sql(), ['item_id'])}
SELECT item_id, verse_id, tokens, round(tfidf, 6) AS tfidf, round(proportion, 6) AS proportion FROM pm"""


def top_matches_sql(p: QuotationParams, k: int) -> str:
    return f"""WITH {base_ctes(p, documents_pages_sql(), ['item_id'])}
SELECT item_id, verse_id, tokens, round(tfidf, 6) AS tfidf, round(proportion, 6) AS proportion
FROM pm ORDER BY tokens DESC, item_id, verse_id LIMIT {k}"""


def match_statistics_sql(p: QuotationParams) -> str:
    keep = f"(tokens >= {p.min_tokens!r} OR tfidf >= {p.min_tfidf!r})"
    return f"""WITH {base_ctes(p, documents_pages_sql(), ['item_id'])}
SELECT count(*) AS n_potential,
       count(*) FILTER (WHERE {keep}) AS n_kept,
       count(*) FILTER (WHERE {keep} AND {prob_sql(p.model)} >= {p.min_probability!r}) AS n_accepted,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {keep}) * 100.0 / count(*) END, 1) AS pct_kept
FROM pm"""


def verse_weights_sql(p: QuotationParams) -> str:
    return f"""WITH {base_ctes(p, "SELECT 'x' AS item_id, '' AS text", ['item_id'])}
SELECT verse_id, gram, CAST(n_v AS BIGINT) AS n_v, round(w, 6) AS w, CAST(verse_len AS BIGINT) AS verse_len,
       CAST(df AS BIGINT) AS df FROM vw"""


def page_quotations_sql(p: QuotationParams) -> str:
    pages = f"SELECT item_id, page_seq, text FROM ({STANDIN['doc_pages']})"
    return f"""WITH {base_ctes(p, pages, ['item_id', 'page_seq'])},
{scored_ctes(p)},
acc1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, verse_id
                                                     ORDER BY probability DESC, page_seq ASC) AS rp
                        FROM kept) WHERE rp = 1 AND probability >= {p.min_probability!r}),
acc2 AS (SELECT *, regexp_replace(verse_id, ' \\(.+\\)', '') AS reference_id,
               CASE WHEN strpos(verse_id, '{p.preferred_label}') > 0 THEN probability + {p.bonus!r}
                    ELSE probability END AS prob_adj FROM acc1),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, reference_id
                                     ORDER BY prob_adj DESC, verse_id ASC) AS rn FROM acc2)
SELECT item_id, reference_id, verse_id, page_seq, round(probability, 6) AS probability
FROM best WHERE rn = 1"""


def _solve_sql(last: str) -> str:
    """One Newton step from the sums in CTE ``last``: four equations by elimination, one column a level."""
    k = 4
    cell = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in range(k) for j in range(k)}
    sql = f"SELECT *, {', '.join(f'{cell[i, j]} AS a{i}{j}' for i in range(k) for j in range(k))}, {', '.join(f'g{i} AS a{i}{k}' for i in range(k))} FROM {last}"
    for p in range(k):
        rows = ", ".join(f"a{i}{j} - a{i}{p} / a{p}{p} * a{p}{j} AS a{i}{j}" for i in range(k) if i != p for j in range(p, k + 1))
        sql = f"SELECT * REPLACE ({rows}) FROM ({sql})"
    sql = f"SELECT b0, b1, b2, b3, step, {', '.join(f'a{i}{k} / a{i}{i} AS d{i}' for i in range(k))} FROM ({sql})"
    sql = f"SELECT *, least(1.0, {MAX_STEP!r} / greatest({', '.join(f'abs(d{i})' for i in range(k))}, {MAX_STEP!r})) AS part FROM ({sql})"
    return f"SELECT {', '.join(f'b{i} + part * d{i} AS b{i}' for i in range(k))}, step + 1 AS step FROM ({sql})"


def fit_sql(p: QuotationParams, reg: float, columns: tuple, steps: int = 30) -> str:
    """The match model fitted by a recursive query: each step sums over all pairs and solves four equations."""
    z = "b0 + b1 * x1 + b2 * x2 + b3 * x3"
    first = ", ".join(f"sum(x{i} * (y - p)) - any_value(penalty * b{i} * {int(i > 0)}) AS g{i}" for i in range(4))
    second = ", ".join(f"sum(x{i} * x{j} * p * (1 - p)) + any_value(penalty * {int(i == j > 0)}) AS h{i}{j}" for i in range(4) for j in range(i, 4))
    names = ("b0", "b1", "b2", "b3", "m1", "m2", "m3", "s1", "s2", "s3")
    return f"""WITH RECURSIVE {base_ctes(p, documents_pages_sql(), ['item_id'])},
labelled AS MATERIALIZED (SELECT m.tokens, m.tfidf, m.proportion, (strpos(d.text, v.text) > 0)::DOUBLE AS y
  FROM pm m JOIN pages_in d ON d.item_id = m.item_id JOIN verses v ON v.verse_id = m.verse_id),
facts AS MATERIALIZED (SELECT count(*) AS n, sum(y) AS ones, avg(tokens) AS m1, avg(tfidf) AS m2, avg(proportion) AS m3,
  stddev_samp(tokens) AS s1, stddev_samp(tfidf) AS s2, stddev_samp(proportion) AS s3 FROM labelled),
z AS MATERIALIZED (SELECT y, 1.0::DOUBLE AS x0, (tokens - m1) / s1 AS x1, (tfidf - m2) / s2 AS x2, (proportion - m3) / s3 AS x3,
  n * {reg!r}::DOUBLE AS penalty FROM labelled, facts),
fit AS (
  SELECT ln(ones / (n - ones)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0 AS step FROM facts
  UNION ALL
  SELECT * FROM ({_solve_sql(f"(SELECT b0, b1, b2, b3, step, {first}, {second} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM fit, z WHERE step < {steps}) GROUP BY b0, b1, b2, b3, step)")}))
SELECT {", ".join(f"round({a}, 6) AS {c}" for a, c in zip(names, columns))}, n AS n_pairs, ones::BIGINT AS n_positive
FROM fit, facts WHERE step = {steps}"""
