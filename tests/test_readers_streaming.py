import json
import os

from pyspark.sql import functions as F

from scholia.operators import tables as TB
from scholia.sources import readers as RD
from scholia.streaming import runners as RN


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_books_lines_and_concatenated(spark, tmp_path):
    a = {"lccn": "1", "title": "A", "publication_date": ["1901-02-03"], "language": ["english"], "text_en": "x"}
    b = {"lccn": "2", "title": "B", "publication_date": {"raw": "n.d."}, "text_en": "y"}
    c = {"lccn": "3", "title": "C", "publication_date": "1999-12-31"}
    d = str(tmp_path / "books")
    _write(d, "one.json", json.dumps(a) + "\n{bad json\n" + json.dumps(b) + "\n")
    _write(d, "skip.txt", json.dumps(c) + "\n")
    books, rejects = RD.read_books(spark, d)
    assert sorted(r.lccn for r in books.collect()) == ["1", "2"] and rejects.count() == 1
    rows = {r.lccn: r.year for r in RD.book_rows(books, F.current_timestamp()).collect()}
    assert rows == {"1": 1901, "2": 0}
    meta = json.loads(RD.book_rows(books, F.current_timestamp()).filter("lccn = '1'").first().original_metadata)
    assert meta["text_en"] == ""
    d2 = str(tmp_path / "books2")
    _write(d2, "two.json", json.dumps(a) + json.dumps(c) + "\n" + json.dumps(b, indent=2) + "\n{oops}\n")
    books2, rej2 = RD.read_books(spark, d2)
    assert sorted(r.lccn for r in books2.collect()) == ["1", "2", "3"] and rej2.count() == 1


def test_books_over_lines(spark, tmp_path):
    rec = lambda i, **k: {"lccn": str(i), "title": "T {%d} \"}\"" % i, **k}
    d = str(tmp_path / "books")
    pretty = lambda i: json.dumps(rec(i, publication_date={"raw": {"title": "inner"}}), indent=2)
    # one file each: pretty records glued together, a broken one in the middle, an open one at the end
    _write(d, "a.json", pretty(1) + pretty(2) + "\n" + pretty(3) + json.dumps(rec(4)) + json.dumps(rec(5)))
    _write(d, "b.json", pretty(6) + "\n" + pretty(7).replace('"lccn":', '"lccn"') + "\n" + pretty(8) + "\n")
    _write(d, "c.json", json.dumps(rec(9)) + "\n\n" + pretty(10)[:-1])
    _write(d, "d.json", json.dumps(rec(11)) + "{oops}" + json.dumps(rec(12)) + "\n[1, 2]\n")
    _write(d, "e.json", "")
    books, rejects = RD.read_books(spark, d)
    assert sorted(int(r.lccn) for r in books.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 11]
    bad = sorted(r.record for r in rejects.collect())
    assert len(bad) == 4 and sum("inner" in b for b in bad) == 2      # 7 and 10, the rest of 11's line, the list
    order = [int(r.lccn) for r in books.filter(F.col("_file").endswith("a.json")).orderBy("_seq").collect()]
    assert order == [1, 2, 3, 4, 5]


def test_csv_round_trip_keeps_quotes_and_newlines(spark, tmp_path):
    rows = [("j", "1", 'He said "hi"\nand left'), ("j", "2", "plain"), ("j", "3", None)]
    df = spark.createDataFrame(rows, "job_id string, doc_id string, text string")
    p = str(tmp_path / "batch")
    RD.write_document_batch(df, p)
    assert sorted(RD.read_document_batch(spark, p).collect(), key=lambda r: r.doc_id) == \
        sorted(df.collect(), key=lambda r: r.doc_id)


def test_predictions_quarantine(spark, tmp_path):
    p = str(tmp_path / "pred")
    _write(p, "a.csv", "123e4567-e89b-12d3-a456-426614174000,i,R,R (KJV),0.9\nnot-a-uuid,i,R,R (KJV),0.8\n"
                       "123e4567-e89b-12d3-a456-426614174000,i,S,S (KJV),abc\n")
    good, bad = RD.read_predictions(spark, p)
    assert good.count() == 1 and bad.count() == 2


def test_dead_letters_stream(spark, tmp_path):
    land = str(tmp_path / "land")
    _write(land, "m.json", json.dumps({"job_id": "123e4567-e89b-12d3-a456-426614174000", "item_id": "i",
                                       "full_text": "t"}) + "\nnot json\n" + json.dumps({"job_id": "x"}) + "\n")
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    RN.run(RN.route_messages(spark, land, good, dead, str(tmp_path / "ck")))
    assert spark.read.parquet(good).count() == 1
    assert sorted(r.reason for r in spark.read.parquet(dead).collect()) == ["malformed", "missing key"]
    # a second run over the same files adds nothing (checkpointed offsets)
    RN.run(RN.route_messages(spark, land, good, dead, str(tmp_path / "ck")))
    assert spark.read.parquet(good).count() == 1


def test_stream_ingest_equals_batch_upsert(spark, tmp_path):
    land, table, ck = str(tmp_path / "items"), str(tmp_path / "tbl"), str(tmp_path / "ck")
    rec = lambda i, t, *urls: json.dumps({"item": {"id": i, "title": t, "date": "1901-01-01"},
                                          "resources": [{"url": u, "files": [[{"url": u + ".txt"}]]} for u in urls]})
    _write(os.path.join(land, "b=1"), "x.json", rec("a", "draft", "u1", "u2") + "\n" + rec("b", "B", "u3") + "\n")
    RN.run(RN.ingest_items(spark, land, table, ck))
    # a second landing: the item changes and loses a resource, the other one stays
    _write(os.path.join(land, "b=2"), "x.json", rec("a", "final", "u4") + "\n")
    RN.run(RN.ingest_items(spark, land, table, ck))
    now = RN.current_items(spark, table)
    assert sorted((r.id, r.title, r.year) for r in now["items"].collect()) == [("a", "final", 1901), ("b", "B", 1901)]
    assert sorted((r.item_id, r.url) for r in now["resources"].collect()) == [("a", "u4"), ("b", "u3")]
    assert sorted((r.item_id, r.url) for r in now["files"].collect()) == [("a", "u4.txt"), ("b", "u3.txt")]
    # another stream over the same files adds its own change rows and changes nothing
    RN.run(RN.ingest_items(spark, land, table, str(tmp_path / "ck2")))
    assert sorted((r.id, r.title) for r in RN.current_items(spark, table)["items"].collect()) == [("a", "final"), ("b", "B")]


def test_listing_pages_and_pretty_records(spark, tmp_path):
    listing = {"results": [{"id": "c1", "title": "One", "description": ["first", "second"], "count": 3,
                            "items": "https://api.example.org/collections/c1/", "subject": ["s"],
                            "item": {"subjects": ["x"]}, "extra": 1},
                           {"id": "c2", "title": "Two", "description": [], "count": 0}]}
    _write(str(tmp_path / "listing"), "p1.json", json.dumps(listing, indent=2))
    c = {r.id: r for r in RD.read_collections(spark, str(tmp_path / "listing")).collect()}
    assert c["c1"].description == "first" and c["c2"].description == "" and c["c1"].subjects2 == ["x"]
    assert json.loads(c["c1"].api)["id"] == "c1"
    page = {"title": "One", "pagination": {"current": 2}, "results": [{"id": "i1", "url": "u1"}, {"id": "i2"}]}
    _write(str(tmp_path / "pages" / "collection_id=c1"), "a.json", json.dumps(page) + "\n")
    rows = sorted((r.collection_id, r.page, r.item_id) for r in
                  RD.read_collection_pages(spark, str(tmp_path / "pages")).collect())
    assert rows == [("c1", 2, "i1"), ("c1", 2, "i2")]
    rec = {"item": {"id": "i1", "date": "1980-09-09", "title": "T"}, "resources": []}
    _write(str(tmp_path / "recs"), "i1.json", json.dumps(rec, indent=2))
    got = RD.read_item_records(spark, str(tmp_path / "recs"), multiline=True)
    items = RD.item_rows(got, F.current_timestamp()).collect()
    assert [(r.id, r.year) for r in items] == [("i1", 1980)]


def test_message_round_trip(spark, tmp_path):
    msg = [("123e4567-e89b-12d3-a456-426614174000", "item/1", 'Full "text"\nwith lines')]
    df = spark.createDataFrame(msg, "job_id string, item_id string, full_text string")
    p = str(tmp_path / "msgs")
    RN.write_messages(df, p)
    back = spark.read.schema("job_id string, item_id string, full_text string").json(p).collect()
    assert [tuple(r) for r in back] == msg


def test_books_first_writer_wins(spark, tmp_path):
    from scholia.operators import tables as TB2
    d = str(tmp_path / "dups")
    _write(d, "a.json", "\n".join(json.dumps({"lccn": "9", "title": t}) for t in ["first", "second", "third"]) + "\n")
    books, _ = RD.read_books(spark, d)
    rows = RD.book_rows(books, F.current_timestamp(), keep=["_file", "_seq"])
    empty = rows.limit(0).drop("_file", "_seq")
    got = TB2.insert_if_absent(empty, rows, ["lccn"], order=["_file", "_seq"]).collect()
    assert [(r.lccn, r.title) for r in got] == [("9", "first")]


def test_stream_ingest_restart_changes_nothing(spark, tmp_path):
    land, table, ck = str(tmp_path / "items"), str(tmp_path / "tbl"), str(tmp_path / "ck")
    rec = json.dumps({"item": {"id": "a", "title": "A", "date": "1901-01-01"}, "resources": []})
    _write(os.path.join(land, "b=1"), "x.json", rec + "\n")
    RN.run(RN.ingest_items(spark, land, table, ck))
    before = spark.read.parquet(f"{table}/items").inputFiles()
    RN.run(RN.ingest_items(spark, land, table, ck))
    assert spark.read.parquet(f"{table}/items").inputFiles() == before
    assert RN.current_items(spark, table)["items"].count() == 1


def test_half_written_version_does_not_count(spark, tmp_path):
    """Killed between the writes: children without their item row stay unseen."""
    land, table, ck = str(tmp_path / "items"), str(tmp_path / "tbl"), str(tmp_path / "ck")
    rec = lambda u: json.dumps({"item": {"id": "a", "title": "A"}, "resources": [{"url": u, "files": []}]})
    _write(os.path.join(land, "b=1"), "x.json", rec("old") + "\n")
    RN.run(RN.ingest_items(spark, land, table, ck))
    late = spark.read.parquet(f"{table}/resources").drop("stream", "epoch").withColumn("url", F.lit("new")) \
        .withColumn("_at", F.col("_at").withField("_path", F.lit("later")))
    late.write.parquet(RN.epoch_folder(f"{table}/resources", ck, 1))
    assert [r.url for r in RN.current_items(spark, table)["resources"].collect()] == ["old"]
    _write(os.path.join(land, "b=2"), "x.json", rec("new") + "\n")      # the replay of epoch 1
    RN.run(RN.ingest_items(spark, land, table, ck))
    assert [r.url for r in RN.current_items(spark, table)["resources"].collect()] == ["new"]


def test_ingest_takes_the_later_line_and_keeps_rejects(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    line = '{"item": {"id": "http://x/1", "title": "%s"}, "resources": []}'
    (land / "a.txt").write_text("\n".join([line % "zzz old", "no json", line % "aaa new"]))
    table = str(tmp_path / "t")
    RN.run(RN.ingest_items(spark, str(land), table, str(tmp_path / "ck")))
    assert [r.title for r in RN.current_items(spark, table)["items"].collect()] == ["aaa new"]
    assert [r.record for r in spark.read.parquet(str(tmp_path / "ck-rejects")).collect()] == ["no json"]
