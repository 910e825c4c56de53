import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.functions import dates as DT
from scholia.functions import text as T


def go_year(s, min_len=5):
    """Plain-Python statement of the year rule (length gate, first four
    characters, optionally signed integer without blanks)."""
    if s is None or len(s) < min_len:
        return None
    head = s[:4]
    return int(head) if re.fullmatch(r"[+-]?[0-9]+", head) else None


ALPHABET = st.sampled_from(list("0123456789-+ ?/aé"))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=8), min_size=1, max_size=30))
def test_year_rule_matches_plain_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select(DT.year_of(F.col("s")).alias("a"), DT.year_of(F.col("s"), 4).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(go_year(v), go_year(v, 4)) for v in values]


WORDS = st.text(st.sampled_from(list("abcé ,.!\n'-1")), max_size=60)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=10), st.integers(min_value=1, max_value=3))
def test_word_ngrams_match_plain_python(spark, texts, n):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = sorted((r.k, r.gram) for r in T.explode_ngrams(df, ["k"], "t", n).collect())
    want = []
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        want += [(i, " ".join(w[j:j + n])) for j in range(len(w) - n + 1)]
    assert got == sorted(want)
