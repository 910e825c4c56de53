import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from scholia.functions import dates as DT
from scholia.functions import records as R
from scholia.functions import text as T
from scholia.functions.markup import decode_references, markup_to_text


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_year_strict_and_lenient(spark):
    cases = [("1980-09-09", 1980, 1980), ("19??-09-09", None, None), ("1980", None, 1980),
             ("", None, None), ("-500-01", -500, -500), (" 198-", None, None), (None, None, None)]
    for s, strict, lenient in cases:
        assert _one(spark, DT.year_of(F.col("x")), s) == strict, s
        assert _one(spark, DT.year_of(F.col("x"), min_len=4), s) == lenient, s


def test_book_year(spark):
    assert _one(spark, DT.book_year(F.col("x")), '["1901-02-03", "1999-01-01"]') == 1901
    assert _one(spark, DT.book_year(F.col("x")), '"circa 1900"') == 0
    assert _one(spark, DT.book_year(F.col("x"), on_error="null"), '"circa 1900"') is None


def test_resource_urls(spark):
    assert _one(spark, R.is_resource(F.col("x")), "https://api.example.org/resource/abc/") is True
    assert _one(spark, R.is_resource(F.col("x")), "https://api.example.org/item/abc/") is False
    assert _one(spark, R.has_api(F.col("x")), "https://api.example.org/collections/x/") is True
    assert _one(spark, R.has_api(F.col("x")), "http://memory.example.org/x") is False


def test_fetch_urls(spark):
    url = _one(spark, R.item_fetch_url(F.col("x")), "https://api.example.org/item/abc/?sp=2")
    assert url == "https://api.example.org/item/abc/?at%21=more_like_this%2Crelated_items%2Ccite_this%2Coptions&fo=json"
    page = spark.createDataFrame([("https://api.example.org/collections/c/", 3)], "u string, p int") \
        .select(R.collection_page_url(F.col("u"), F.col("p"))).first()[0]
    assert "&c=1000&fa=online-format%3Aonline+text&fo=json&sp=3&st=list" in page
    assert page.startswith("https://api.example.org/collections/c/?at%21=aka%2Cbreadcrumbs")


def test_sentences_and_grams(spark):
    text = ("This is a dummy document. Ese reloj fue un regalo de mi mujer.  It has two English, one Spanish, "
            "and one German sentences. Ich möchte ein Bier.")
    s = _one(spark, T.sentences(F.col("x")), text)
    assert len(s) == 4 and s[1] == "Ese reloj fue un regalo de mi mujer."
    assert _one(spark, T.sentences(F.col("x")), "Dr. Who is here. Yes!\nNext line") == \
        ["Dr. Who is here.", "Yes!", "Next line"]
    df = spark.createDataFrame([("k", "One, two! Two three"), ("short", "one"), ("empty", ""), ("null", None)],
                               "k string, t string")
    got = {r["k"]: r["gram"] for r in T.explode_ngrams(df, ["k"], "t", 2).collect()}
    rows = T.explode_ngrams(df, ["k"], "t", 2).collect()
    assert sorted(r["gram"] for r in rows) == ["one two", "two three", "two two"]
    assert "short" not in got and "empty" not in got
    chars = [r["gram"] for r in T.explode_char_ngrams(df.filter("k = 'short'"), ["k"], "t", 3).collect()]
    assert chars == [" on", "one", "ne "]


def test_markup_to_text(spark):
    page = ('<html><head><title>T &amp; U</title><script>var x="</p>";</script><style>p{}</style></head>'
            '<body><p>Hello <b>world</b></p><!-- gone --><div>A&lt;B</div></body></html>')
    assert _one(spark, markup_to_text(F.col("x")), page) == "T & U\nHello world\nA<B"


def test_markup_tokens(spark):
    cases = {
        '<a title="x > y">in</a>': "in", "<p class='a>b'>in</p>out": "in\nout", "a < b > c": "a < b > c", "a<b": "a<b",
        "in<!-- open > <p>gone": "in", "in<SCRIPT src='>'>gone": "in", "<style>p{}</style >in": "in", "x<!DOCTYPE html>y<?pi ?>z": "xyz",
        '<a title="x>in</a>': "in", "<![CDATA[in]]>": "in", "<b>a</b>b": "ab", "<title/>T<br/>U": "T\nU", "<preface>a</preface>b": "ab",
        "a\u0001b": "ab", "": "", "a&nbsp;&#160;b": "a b", "&amp;lt;p&amp;gt;": "&lt;p&gt;", "<p " + 'k="v" ' * 150 + ">in": "in",
        "<i>" * 20000 + "in": "in", "<!-- " + "x>" * 50000 + "-->in": "in", "<p " + "x" * 100000 + ">in": "in"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "x string, want string")
    assert [r for r in df.select("want", markup_to_text("x").alias("got")).collect() if r.want != r.got] == []


def test_references_as_the_standard_library(spark):
    r = random.Random(6)
    names = list(html5)
    bits = ["&", "#", "#x", "#X", ";", "amp", "lt;", "not", "it", "x", "é", "0", "41", "1F600", "128", "55296", "99999999999", "65534", "&&", " ", "\n", "\ufeff"]
    texts = ["".join(r.choice(bits) if r.random() < 0.8 else "&" + r.choice(names) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    texts += ["&" + n for n in names] + [f"&#{i};" for i in range(300)] + [f"&#x{i:x}" for i in (0xD7FF, 0xD800, 0xFDD0, 0xFEFF, 0xFFFF, 0x10FFFF, 0x110000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    wrong = [(x, got, html.unescape(x)) for x, got in df.select("x", decode_references("x")).collect() if got != html.unescape(x)]
    assert wrong == []


def test_versions(spark):
    assert _one(spark, T.strip_version(F.col("x")), "Matthew 1:1 (KJV)") == "Matthew 1:1"
    # two bracketed parts: the greedy span removes both
    assert _one(spark, T.strip_version(F.col("x")), "Psalm 23:1 (a) (KJV)") == "Psalm 23:1"
    assert _one(spark, T.drop_last_words(F.col("x"), 2), "one two three four") == "one two"
    df = spark.createDataFrame([("John 3:16 (KJV)", 0.6), ("John 3:16 (ASV)", 0.6)], "v string, p double")
    got = [r[0] for r in df.select(T.version_bonus("v", "p")).collect()]
    assert abs(got[0] - 0.65) < 1e-12 and got[1] == 0.6


def test_uuid_and_status(spark):
    u = _one(spark, R.uuid_of(F.col("x"), F.lit("quotations")), "doc/1")
    assert len(u) == 36 and _one(spark, R.is_uuid(F.col("x")), u) is True
    assert _one(spark, R.status_rank(F.col("x")), "failed") == 4


def test_json_paths(spark):
    df = spark.createDataFrame([('{"item":{"id":"a","language":["english"]},"k":7}',), ("not json",)], "x string")
    rows = df.select(R.json_path("x", "$.item.id").alias("a"),
                     R.json_path("x", "$.k", variant=True, as_type="int").alias("b"),
                     R.json_path("x", "$.item.language", variant=True, as_type="array<string>").alias("c")).collect()
    assert (rows[0].a, rows[0].b, rows[0].c) == ("a", 7, ["english"])
    assert (rows[1].a, rows[1].b, rows[1].c) == (None, None, None)
