import datetime as dt

from pyspark.sql import functions as F

from scholia.operators import items as I
from scholia.operators import jobs as J
from scholia.operators import tables as TB
from scholia.sources import schemas as SC

NOW = dt.datetime(2024, 1, 2, 12, 0, 0)


def _items(spark, rows):
    return spark.createDataFrame(rows, "id string, url string, api string, updated timestamp")


def test_unfetched_only_without_api(spark):
    it = _items(spark, [("a", "u/item/a", None, NOW), ("b", "u/item/b", None, NOW - dt.timedelta(1)),
                        ("c", "u/item/c", '{"test":"test"}', NOW)])
    assert [r.id for r in I.unfetched(it).collect()] == ["a", "b"]


def test_fetch_backlog_cooldown(spark):
    it = _items(spark, [("old", "u/item/1", None, NOW), ("recent", "u/item/2", None, NOW),
                        ("never", "u/item/3", None, NOW), ("res", "u/resource/4", None, NOW)])
    fail = spark.createDataFrame([("old", NOW - dt.timedelta(hours=2)), ("recent", NOW - dt.timedelta(minutes=15))],
                                 "item_id string, failed_at timestamp")
    now = F.lit(NOW)
    got = sorted(r.id for r in I.fetch_backlog(it, fail, now).collect())
    assert got == ["never", "old"]
    gate = I.backlog_gate(it, fail, now).first()
    assert (gate.n_unfetched, gate.n_cooling, gate.work) == (4, 1, True)


def test_page_text_plain_wins(spark):
    rows = [("plain", 0, 0, 0, "text/plain", "p0"), ("plain", 0, 0, 1, "text/xml", "<p>x</p>"),
            ("plain", 1, 0, 0, "text/plain", "p1"), ("xml", 0, 0, 0, "text/xml", "<p>x &amp; y</p>"),
            ("none", 0, 0, 0, "image/jpeg", None), ("nulltext", 0, 0, 0, "text/plain", None)]
    files = spark.createDataFrame(rows, "item_id string, resource_seq int, file_seq int, format_seq int, "
                                        "mimetype string, fulltext string")
    got = sorted((r.item_id, r.resource_seq, r.text) for r in I.page_text(files).collect())
    assert got == [("plain", 0, "p0"), ("plain", 1, "p1"), ("xml", 0, "x & y")]


def test_create_jobs_once_per_item(spark):
    items = spark.createDataFrame([(f"{i:04d}", "{}") for i in range(500)], "id string, api string")
    empty = spark.createDataFrame([], SC.JOBS)
    first = J.create_jobs(items, empty, "quotations")
    assert first.count() == 500 and first.select("item_id").distinct().count() == 500
    jobs = empty.unionByName(first)
    assert J.create_jobs(items, jobs, "quotations").count() == 0
    assert J.create_jobs(items, jobs, "language").count() == 500


def test_claim_drains_queue(spark):
    items = spark.createDataFrame([(str(i), "{}") for i in range(10)], "id string, api string")
    jobs = J.create_jobs(items, spark.createDataFrame([], SC.JOBS), "language")
    claimed_ids = set()
    now = F.lit(NOW)
    for _ in range(3):
        c = J.claim_jobs(jobs, "language", 4, now)
        ids = {r.id for r in c.collect()}
        assert not ids & claimed_ids
        claimed_ids |= ids
        jobs = J.apply_changes(jobs, c).cache()
    assert len(claimed_ids) == 10
    assert J.claim_jobs(jobs, "language", 4, now).count() == 0


def test_end_jobs_is_permissive(spark):
    jobs = spark.createDataFrame([("j1", "i1", "d", NOW, None, "running")], SC.JOBS)
    for status in ["skipped", "failed", "finished"]:
        jobs = J.end_jobs(jobs, spark.createDataFrame([("j1", status)], "id string, outcome string"), F.lit(NOW))
        r = jobs.first()
        assert r.status == status and r.finished is not None


def test_retry_drops_results(spark):
    jobs = spark.createDataFrame([("a", "i", "d", None, None, "failed"), ("b", "i", "d", None, None, "finished")],
                                 SC.JOBS)
    res = spark.createDataFrame([("a", "x"), ("b", "y")], "job_id string, v string")
    kept, (r,) = J.retry_jobs(jobs, [res])
    assert [x.id for x in kept.collect()] == ["b"] and [x.job_id for x in r.collect()] == ["b"]


def test_insert_twice_changes_nothing(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    load = spark.createDataFrame([("b", 9, 0), ("c", 3, 0), ("c", 4, 1)], "id string, v int, seq int")
    once = TB.insert_if_absent(base, load, ["id"], order=["seq"])
    twice = TB.insert_if_absent(once, load, ["id"], order=["seq"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    up = TB.upsert(base, load, ["id"], order=["seq"])
    assert sorted(up.collect()) == [("a", 1), ("b", 9), ("c", 4)]


def test_shred_then_assemble(spark):
    rec = ('{"item":{"id":"i1","url":"u","date":"1901-01-01","title":"T","language":["english"]},'
           '"resources":[{"url":"r0","caption":"","files":[[{"mimetype":"text/plain","fulltext":"a"},'
           '{"mimetype":"text/xml","fulltext":"<p>a</p>"}],[{"mimetype":"image/jpeg","url":"j"}]]},'
           '{"url":"r1","files":[]}]}')
    df = spark.createDataFrame([(rec,)], "api string").withColumn("record", F.from_json("api", SC.ITEM_RECORD))
    recs = df.select("api", "record", F.col("record.item.id").alias("id"))
    r = I.shred_resources(recs.select("id", "record.resources"))
    f = I.shred_files(recs.select("id", "record.resources"))
    assert r.count() == 2 and r.filter("resource_seq = 0").first().caption is None
    assert sorted((x.resource_seq, x.file_seq, x.format_seq) for x in f.collect()) == [(0, 0, 0), (0, 0, 1), (0, 1, 0)]
    from scholia.sources.readers import item_rows
    nested = I.assemble_items(item_rows(recs, F.lit(NOW)), r, f).first()
    assert nested.year is None or nested.year == 1901
    assert len(nested.resources) == 2 and len(nested.files) == 3


def test_save_items_replaces_children(spark):
    items = spark.createDataFrame([("i1", "a"), ("i2", "a"), ("i3", "a")], "id string, v string")
    res = spark.createDataFrame([("i1", 0, "r0"), ("i1", 1, "r1"), ("i2", 0, "r2"), ("i3", 0, "r3")],
                                "item_id string, resource_seq int, url string")
    files = spark.createDataFrame([("i1", 0, "f"), ("i2", 0, "f2")], "item_id string, resource_seq int, name string")
    out = TB.save_items(items, res, files,
                        spark.createDataFrame([("i1", "b"), ("i3", "b")], "id string, v string"),
                        spark.createDataFrame([("i1", 0, "new")], "item_id string, resource_seq int, url string"),
                        spark.createDataFrame([("i1", 0, "g")], "item_id string, resource_seq int, name string"))
    assert sorted(map(tuple, out["items"].collect())) == [("i1", "b"), ("i2", "a"), ("i3", "b")]
    # an item saved without children loses the ones it had
    assert sorted(r.url for r in out["resources"].collect()) == ["new", "r2"]
    assert sorted(r.name for r in out["files"].collect()) == ["f2", "g"]


def test_manifests(spark):
    from scholia.functions.records import API_BASE
    colls = spark.createDataFrame([("c1", f"{API_BASE}/collections/c1/?x=1", 2500),
                                   ("c2", "https://elsewhere.example/c2/", 10), ("c3", f"{API_BASE}/c3/", 0)],
                                  "id string, items_url string, count int")
    m = I.page_manifest(colls).collect()
    assert sorted((r.collection_id, r.page) for r in m) == [("c1", 1), ("c1", 2), ("c1", 3), ("c3", 1)]
    assert all("&sp=%d&st=list" % r.page in r.url and "?x=1" not in r.url for r in m)
    items = spark.createDataFrame([("a", "https://x/item/a?q=1#f"), ("b", "https://x/resource/b")], "id string, url string")
    assert [(r.id, r.fetch_url.split("?")[0]) for r in I.item_manifest(items).collect()] == [("a", "https://x/item/a")]


def test_cascade_delete_and_audits(spark):
    from scholia.operators import stats as ST
    links = spark.createDataFrame([("a", "c"), ("b", "c")], "item_id string, collection_id string")
    files = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "item_id string, file_seq int")
    out = TB.cascade_delete({"links": (links, "item_id"), "files": (files, "item_id")},
                            spark.createDataFrame([("a",)], "id string"))
    assert [r.item_id for r in out["links"].collect()] == ["b"] and out["files"].count() == 1
    parent = spark.createDataFrame([("b",)], "id string")
    orph = ST.orphans(files, parent, ["item_id"], ["id"], "files").collect()
    assert [(r.key, r.n) for r in orph] == [("a", 2)]
    dup = ST.duplicate_keys(files.select("item_id"), ["item_id"], "files").collect()
    assert [(r.key, r.n) for r in dup] == [("a", 2)]
    jobs = spark.createDataFrame([("not-a-uuid", "i", "d", None, None, "weird")], SC.JOBS)
    assert ST.bad_status(jobs).count() == 1 and ST.bad_uuid(jobs, "id", "jobs").count() == 1


def test_cli_find_quotations(spark, tmp_path):
    from scholia import cli
    spark.createDataFrame([("i1", "in the beginning god created the heaven and the earth")],
                          "item_id string, text string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("Gen 1:1 (KJV)", "In the beginning God created the heaven and the earth")],
                          "verse_id string, text string").write.parquet(str(tmp_path / "verses"))
    cli.main(["find-quotations", "--pages", str(tmp_path / "pages"), "--verses", str(tmp_path / "verses"),
              "--out", str(tmp_path / "out"), "--potential", str(tmp_path / "pot")])
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.item_id, r.reference_id) for r in rows] == [("i1", "Gen 1:1")]
    assert spark.read.option("header", True).csv(str(tmp_path / "pot")).count() == 1


def test_upsert_without_order_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([("a", 1)], "id string, v int")
    load = spark.createDataFrame([("a", 2), ("a", 3), ("b", 4), ("b", 4)], "id string, v int")
    out = TB.upsert(base, load, ["id"]).collect()
    assert sorted(r.id for r in out) == ["a", "b"] and {r.v for r in out if r.id == "a"} <= {2, 3}


def test_orphans_leave_out_keys_with_a_null_part(spark):
    from scholia.operators.stats import orphans
    child = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", 2), ("b", 2)], "i string, n int")
    parent = spark.createDataFrame([("a", 1)], "x string, y int")
    assert [tuple(r) for r in orphans(child, parent, ["i", "n"], ["x", "y"], "t").collect()] == [("t", "orphan", "b|2", 2)]


def test_cli_retry_drops_results(spark, tmp_path):
    from scholia import cli
    jobs = spark.createDataFrame([("1", "failed"), ("2", "finished")], "id string, status string")
    jobs.write.parquet(str(tmp_path / "jobs"))
    for name in ("langs", "quotes"):
        spark.createDataFrame([("1", name), ("2", name)], "job_id string, v string").write.parquet(str(tmp_path / name))
    out = str(tmp_path / "kept")
    cli.main(["retry", "--jobs", str(tmp_path / "jobs"), "--results", str(tmp_path / "langs"), str(tmp_path / "quotes"), "--out", out])
    assert [r.id for r in spark.read.parquet(out).collect()] == ["2"]
    assert [r.job_id for r in spark.read.parquet(out + "-langs").collect()] == ["2"]
    assert [r.job_id for r in spark.read.parquet(out + "-quotes").collect()] == ["2"]


def test_page_processor_fails_one_job_alone(spark, tmp_path):
    from pyspark.sql import functions as F

    from scholia.plans import processors as P

    @P.register_pages("shout", "loud string")
    def shout(page):
        if page["text"] == "bad":
            raise KeyError("bad page")
        return [{"loud": page["text"].upper()}] * 2

    items = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{}"), ("n", "{}")], "id string, api string")
    files = spark.createDataFrame([(i, k, 0, 0, "text/plain", t) for i, k, t in [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "good"), ("b", 1, "bad"), ("c", 0, "z")]],
                                  "item_id string, resource_seq int, file_seq int, format_seq int, mimetype string, fulltext string")
    jobs = spark.createDataFrame([], "id string, item_id string, destination string, started timestamp, finished timestamp, status string")
    run = P.run_page_processor("shout", items, jobs, files, F.current_timestamp(), str(tmp_path / "sink"))
    assert sorted((r["item_id"], r["loud"]) for r in run.results.collect()) == [("a", "X"), ("a", "X"), ("a", "Y"), ("a", "Y"), ("c", "Z"), ("c", "Z")]
    assert {r["item_id"]: r["status"] for r in run.jobs.collect()} == {"a": "finished", "b": "failed", "c": "finished", "n": "skipped"}
    assert [tuple(r) for r in run.errors.select("item_id", "error").collect()] == [("b", "KeyError: 'bad page'")]
    again = P.run_page_processor("shout", items, run.jobs.persist(), files, F.current_timestamp(), str(tmp_path / "again"))
    assert again.results.count() == 0 and again.jobs.count() == 4


def test_audit_reads_a_table_once(spark, tmp_path):
    from scholia.operators import stats as ST
    rows = [("a|b", "c", 1), ("a", "b|c", None), ("a", "x", None), ("a", "x", 4), ("a", "x", None), (None, "x", 5), (None, "x", 6)]
    spark.createDataFrame(rows, "k string, l string, v int").withColumn("row", F.lit("clash")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = ST.audit(df, "t", [["k", "l"], ["l"]], {"v is null": (F.col("v").isNull(), ["k", "l"]), "v large": (F.col("v") > 5, ["l"])})
    assert sorted(tuple(r) for r in got.collect()) == sorted([
        ("t", "duplicate key", "a|x", 3), ("t", "duplicate key", "x", 2), ("t", "duplicate key", "x", 5), ("t", "v is null", "a|b|c", 1),
        ("t", "v is null", "a|x", 1), ("t", "v is null", "a|x", 1), ("t", "v large", "x", 1)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "clash" not in plan
    assert ST.audit(df.limit(0), "t", [["k"]]).count() == 0
