import random

from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import language as L

# A tiny hand-written training table (real-language words; the driver's
# documents are in invented languages).
TRAIN = [
    ("en", "the house is big and the garden is green. it has two english sentences and a dog. "
           "this is a dummy document with words that are english. where is the water? "
           "they have the book and the pen. she reads the letter in the morning."),
    ("es", "el reloj fue un regalo de mi mujer. la casa es grande y el jardín es verde. "
           "tengo un perro y una gata. ella lee la carta por la mañana. dónde está el agua?"),
    ("de", "ich möchte ein bier. das haus ist groß und der garten ist grün. "
           "wir haben einen hund und eine katze. sie liest den brief am morgen. wo ist das wasser?"),
]
TEXT = ("This is a dummy document. Ese reloj fue un regalo de mi mujer.  It has two English, one Spanish, "
        "and one German sentences. Ich möchte ein Bier.")


def test_four_sentences(spark):
    prof = L.Profiles.build(L.train_profiles(spark.createDataFrame(TRAIN, "lang string, text string")))
    pages = spark.createDataFrame([("item", 0, TEXT)], "item_id string, page_seq int, text string")
    det = L.sentence_languages(pages, prof, keys=["item_id", "page_seq"])
    counts = {r.lang: r.sentences for r in L.language_counts(det).collect()}
    assert counts == {"DEU": 1, "ENG": 2, "SPA": 1}


def test_undetermined_and_multilingual(spark):
    prof = L.Profiles.build(L.train_profiles(spark.createDataFrame(TRAIN, "lang string, text string")))
    pages = spark.createDataFrame([("a", 0, "123 456. ..."), ("b", 0, TEXT), ("b", 1, "Wo ist das Wasser? Der Hund.")],
                                  "item_id string, page_seq int, text string")
    det = L.sentence_languages(pages, prof, keys=["item_id", "page_seq"])
    counts = L.language_counts(det)
    assert {r.lang for r in counts.filter("item_id = 'a'").collect()} == {"UND"}
    multi = L.multilingual_items(counts, min_sentences=1, min_share=0.1).collect()
    assert [r.item_id for r in multi] == ["b"] and multi[0].languages == "DEU,ENG,SPA"
    declared = spark.createDataFrame([("b", ["German"])], "item_id string, languages array<string>")
    agree = L.language_agreement(counts, declared).first()
    assert agree.detected == "DEU" and agree.agrees is True


def test_both_detection_paths_agree(spark, monkeypatch):
    train = spark.createDataFrame([("en", "this is a dog and the house"), ("de", "das ist ein hund und das haus"),
                                   ("xx", "\U0001d4d0\U0001d4d1\U0001d4d2 zz")], "lang string, text string")
    prof = L.Profiles.build(L.train_profiles(train))
    texts = ["This is the dog. Das Haus ist ein Hund! 123. a", None, "", "\U0001d4d0\U0001d4d1\U0001d4d2. Qqq", "the. " * 300]
    pages = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "item_id long, text string")
    rows = lambda: sorted(map(tuple, L.sentence_languages(pages, prof, ["item_id"]).collect()), key=repr)
    near = rows()
    monkeypatch.setattr(L, "CHUNK", 50)
    chunked = rows()
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert near == chunked == rows()
    assert (0, 0, "ENG") in near and (0, 1, "DEU") in near and (0, 2, "UND") in near and (3, 0, "xx") in near
    assert len(near) == 306


def _old_train(df, n):
    """Profiles as they were counted: a row per gram."""
    src = df.filter("lang IS NOT NULL")
    return T.explode_char_ngrams(src, ["lang"], "text", n).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("count"))


def test_profiles_counted_where_the_text_is_read(spark, monkeypatch):
    rows = TRAIN + [("xx", "a"), ("xx", ""), ("xx", None), (None, "no language"), ("zz", "\U0001d538\U0001d539 \u4e2d\u6587\u5b57 \u00df"), ("xx", "Long text " * 50)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(L, "CHUNK", 64)                   # texts longer than a chunk, chunks with several texts
    for n in (1, 2, 3):
        new = L.train_profiles(df, n=n, label_map=None)
        assert sorted(new.collect()) == sorted(_old_train(df, n).collect())
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan   # no row per gram


def test_grams_found_by_place_or_by_search(spark, monkeypatch):
    prof = L.Profiles.build(L.train_profiles(spark.createDataFrame(TRAIN, "lang string, text string")))
    texts = [t for _, t in TRAIN] + ["\u4e2d\u6587\u5b57 \U0001d538. The \u00fc!", "", "12. x", None]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")
    placed = sorted(L.sentence_languages(pages, prof).collect())
    monkeypatch.setattr(L, "MAX_PLACES", 0)
    assert placed == sorted(L.sentence_languages(pages, prof).collect()) and len(placed) > len(TRAIN)


def test_sentences_split_in_few_passes(spark):
    def steps(col):                                       # the rules one after another
        t = F.regexp_replace(col, T.ABBREVIATIONS, "$1$2\u0002")
        t = F.regexp_replace(F.regexp_replace(t, r"([.!?]+)\s+", "$1\u0001"), r"[\r\n]+", "\u0001")
        return F.filter(F.transform(F.split(t, "\u0001"), lambda s: F.trim(F.regexp_replace(s, "\u0002", "."))), lambda s: s != F.lit(""))

    rnd = random.Random(5)
    bits = ["Mr", "z.B", "e.g", "St", ".", " ", "\n", "\r", "\t", "(", "!", "?", "a", "\U0001f600", "\u0001", "\u0002", "Dr.", ". "]
    rows = [("".join(rnd.choices(bits, k=rnd.randint(0, 25))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "x string")
    assert df.filter(~steps(F.col("x")).eqNullSafe(T.sentences("x"))).count() == 0
    plan = df.select(T.sentences("x").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2              # and none per sentence
