import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import quotations as Q

VERSES = [("Gen 1:1 (KJV)", "In the beginning God created the heaven and the earth"),
          ("Gen 1:1 (ASV)", "In the beginning God created the heavens and the earth"),
          ("Ps 23:1 (KJV)", "The Lord is my shepherd I shall not want"),
          ("Ps 23:1 (ASV)", "The Lord is my shepherd I shall not want"),
          ("Jn 11:35 (KJV)", "Jesus wept")]
DOCS = [("d1", "He said: in the beginning God created the heaven and the earth. And the earth, the earth!"),
        ("d2", "The Lord is my shepherd; I shall not want. The Lord is my shepherd."),
        ("d3", "Nothing to see here"), ("d4", "wept"), ("d5", "")]


def _brute(n=2):
    tok = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    grams = lambda t: Counter(" ".join(w[i:i + n]) for w in [tok(t)] for i in range(len(w) - n + 1))
    vg = {v: grams(t) for v, t in VERSES}
    N = len(VERSES)
    df = Counter(g for c in vg.values() for g in c)
    out = {}
    for d, t in DOCS:
        dg = grams(t)
        for v, c in vg.items():
            shared = set(c) & set(dg)
            if not shared:
                continue
            L = sum(c.values())
            tokens = sum(c[g] * dg[g] for g in shared)
            tfidf = sum(c[g] / L * math.log(N / (df[g] + 1)) * dg[g] for g in shared)
            out[(d, v)] = (tokens, tfidf, tokens / L)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    verses = spark.createDataFrame(VERSES, "verse_id string, text string")
    return Q.ReferenceCorpus.build(verses, Q.QuotationParams())


def test_potential_matches_brute_force(spark, corpus):
    pages = spark.createDataFrame(DOCS, "item_id string, text string")
    got = {(r.item_id, r.verse_id): (r.tokens, r.tfidf, r.proportion)
           for r in Q.potential_matches(pages, corpus).collect()}
    want = _brute()
    assert set(got) == set(want)
    for k, (t, w, p) in want.items():
        assert got[k][0] == t and abs(got[k][1] - w) < 1e-9 and abs(got[k][2] - p) < 1e-9
    # a gram repeated in verse and document counts as a product
    assert got[("d1", "Gen 1:1 (KJV)")][0] > 9


def test_shuffle_path_matches_broadcast(spark, corpus):
    pages = spark.createDataFrame(DOCS, "item_id string, text string")
    a = sorted(Q.potential_matches(pages, corpus).collect())
    b = sorted(Q.potential_matches(pages, corpus, broadcast_bytes=0, salt_buckets=4, hot_df=2).collect())
    assert [(r.item_id, r.verse_id, r.tokens) for r in a] == [(r.item_id, r.verse_id, r.tokens) for r in b]
    assert all(abs(x.tfidf - y.tfidf) < 1e-9 for x, y in zip(a, b))


def test_best_version_ties_and_bonus(spark, corpus):
    pages = spark.createDataFrame(DOCS, "item_id string, text string")
    q = Q.find_quotations(pages, corpus).collect()
    refs = {(r.item_id, r.reference_id): r.verse_id for r in q}
    # identical versions: the bonus picks the preferred label
    assert refs.get(("d2", "Ps 23:1")) == "Ps 23:1 (KJV)"
    assert len({(r.item_id, r.reference_id) for r in q}) == len(q)
    scored = Q.score(spark.createDataFrame([("x", "A (ASV)", 9, 3.0, 1.0), ("x", "A (BBB)", 9, 3.0, 1.0)],
                                           "item_id string, verse_id string, tokens long, tfidf double, "
                                           "proportion double"), Q.MatchModel())
    best = Q.best_version(scored, ["item_id"], Q.QuotationParams()).collect()
    assert [r.verse_id for r in best] == ["A (ASV)"]   # tie: verse_id ascending


def test_prune_keeps_null_tfidf_rule(spark):
    df = spark.createDataFrame([(6, None), (1, None), (1, 2.0)], "tokens long, tfidf double")
    assert Q.keep_candidates(df, 5, 1.0).count() == 2


def test_argument_checks():
    with pytest.raises(ValueError):
        Q.QuotationParams(min_tokens=-1).validate()
    with pytest.raises(ValueError):
        Q.QuotationParams(idf="other").validate()


def test_match_statistics(spark, corpus):
    pages = spark.createDataFrame(DOCS, "item_id string, text string")
    s = Q.match_statistics(Q.potential_matches(pages, corpus), Q.QuotationParams()).first()
    assert s.n_potential == len(_brute()) and s.n_kept <= s.n_potential and s.n_accepted <= s.n_kept


def test_page_grain_one_row_per_reference(spark, corpus):
    pages = spark.createDataFrame([("i", 0, DOCS[0][1]), ("i", 1, DOCS[0][1]), ("i", 2, DOCS[1][1])],
                                  "item_id string, page_seq int, text string")
    out = Q.page_quotations_to_item(pages, corpus).collect()
    assert sorted(r.reference_id for r in out) == ["Gen 1:1", "Ps 23:1"]
    assert [r.page_seq for r in out if r.reference_id == "Gen 1:1"] == [0]


def test_pages_of_an_item_are_never_summed(spark, corpus):
    """Seven pages that share one 2-gram each with a verse are no quotation of it."""
    bits = ["in the sea", "the beginning of it", "oh beginning god of", "if god created all", "he created the sky", "the heaven is up", "and the earth"]
    for schema, rows in (("item_id string, page_seq int, text string", [("i", k, t) for k, t in enumerate(bits)]),
                         ("item_id string, text string", [("i", t) for t in bits])):
        assert Q.find_quotations(spark.createDataFrame(rows, schema), corpus).count() == 0
    whole = spark.createDataFrame([("i", 0, DOCS[0][1]), ("i", 1, "nothing")], "item_id string, page_seq int, text string")
    assert [r.reference_id for r in Q.find_quotations(whole, corpus).collect()] == ["Gen 1:1"]


def test_streaming_keeps_late_pages(spark, corpus, tmp_path):
    """An item's pages in two landings and two runs add up to what a batch finds."""
    from scholia.streaming import runners as RN
    rows = [("i1", 0, DOCS[0][1]), ("i2", 0, DOCS[2][1]), ("i1", 1, DOCS[1][1]), ("i2", 1, DOCS[0][1]), ("i1", 2, DOCS[0][1])]
    pages = spark.createDataFrame(rows, "item_id string, page_seq int, text string")
    out = str(tmp_path / "out")
    for i, part in enumerate([rows[:2], rows[2:]]):
        spark.createDataFrame(part, pages.schema).repartition(2).write.parquet(str(tmp_path / "land" / f"b={i}"))
        RN.run(RN.detect_quotations(spark, str(tmp_path / "land"), pages.schema, corpus, out, str(tmp_path / "ck"), files_per_batch=1))
    batch = sorted(tuple(r) for r in Q.find_quotations(pages, corpus).collect())
    assert batch == sorted(tuple(r) for r in RN.quotation_results(spark, out, corpus).collect()) and len(batch) == 3


def _pair_rows(r, n):
    rows = []
    for _ in range(n):
        t, f, p = r.randint(0, 40), r.uniform(0, 9), r.random()
        rows.append((t, f, p, int(r.random() < 1 / (1 + 2.718281828 ** -(0.1 * t - 0.4 * f + 3 * p - 3)))))
    return rows


def test_fit_match_model(spark):
    rows = _pair_rows(random.Random(8), 600)
    m = Q.fit_match_model(spark.createDataFrame(rows, "tokens long, tfidf double, proportion double, label int"), reg=0.01)
    x = np.array([r[:3] for r in rows], float)
    y = np.array([r[3] for r in rows], float)
    assert np.allclose(m.means, x.mean(0)) and np.allclose(m.scales, x.std(0, ddof=1))
    # the optimum is where the derivatives of the penalised loss vanish
    z = np.c_[np.ones(len(x)), (x - m.means) / m.scales]
    beta = np.array([m.intercept, *m.coefficients])
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ beta))) - len(x) * 0.01 * np.array([0, *m.coefficients])
    assert np.abs(slope).max() < 1e-6
    # a feature that tells the labels apart, and one that never varies
    apart = spark.createDataFrame([(i, 1.0, i / 9, int(i > 4)) for i in range(10)], "tokens long, tfidf double, proportion double, label int")
    m = Q.fit_match_model(apart, reg=0.01)
    assert m.coefficients[0] > 0.5 and m.coefficients[1] == 0 and m.scales[1] == 1
    with pytest.raises(ValueError, match="both kinds"):
        Q.fit_match_model(apart.filter("label = 1"))
    with pytest.raises(ValueError, match="both kinds"):
        Q.fit_match_model(apart.limit(0))


def test_label_pairs_compares_whole_texts(spark):
    r = random.Random(4)
    words = ["a", "ba", "cab", "dab", "Ea", "fab"]
    verses = [(f"v{i}", " ".join(r.choice(words) for _ in range(r.randint(2, 6)))) for i in range(30)]
    docs = [(f"d{i}", r.choice(["", "x"]).join([" ".join(r.choice(words) for _ in range(25)), verses[i][1], r.choice([" ", "", ", "]) + "ab"])) for i in range(30)]
    v = spark.createDataFrame(verses, "verse_id string, text string")
    d = spark.createDataFrame(docs, "item_id string, text string")
    potential = Q.potential_matches(d, Q.ReferenceCorpus.build(v, Q.QuotationParams()))
    got = {(x.item_id, x.verse_id): x.label for x in Q.label_pairs(potential, d, v).collect()}
    assert len(got) == potential.count()
    assert got == {(i, j): int(dict(verses)[j] in dict(docs)[i]) for i, j in got}
    assert 0 < sum(got.values()) < len(got)
