"""Keyed-state streams: once-only processing over restarts and replays, links in any order, cool-downs by timers."""

import datetime as dt
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from scholia.operators import items as I
from scholia.streaming import keyed as K
from scholia.streaming import runners as RN


def test_each_key_is_processed_once(spark, tmp_path):
    landing, results, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "item_id string, page_seq int, text string"
    calls = []

    def process(df):
        calls.append(df.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df

    def run():
        RN.run(K.process_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing), ["item_id", "page_seq"], process, results, ckpt))

    for i in range(3):
        spark.createDataFrame([(f"a{j}", 0, "x") for j in range(i, i + 3)], schema).coalesce(1).write.mode("append").parquet(landing)
    with pytest.raises((StreamingQueryException, RuntimeError)):
        run()
    run()  # the second epoch is replayed
    spark.createDataFrame([("a0", 0, "late copy"), ("a0", 1, "new page"), (None, 0, "null key"), (None, 0, "again")], schema).write.mode("append").parquet(landing)
    run()
    got = sorted((r["item_id"] or "", r["page_seq"]) for r in spark.read.parquet(results).collect())
    assert got == sorted([*((f"a{j}", 0) for j in range(5)), ("a0", 1), ("", 0)])
    plan = K.once_only(spark.read.schema(schema).parquet(landing), ["item_id", "page_seq"])._jdf.queryExecution().toString()
    assert results not in plan


def test_links_of_listings_and_pages_in_any_order(spark, tmp_path):
    listings, pages, table, ckpt = (str(tmp_path / x) for x in ("listings", "pages", "table", "ckpt"))

    def listing(name, *ids):
        (tmp_path / "listings").mkdir(exist_ok=True)
        (tmp_path / "listings" / name).write_text(json.dumps({"results": [{"id": i, "title": f"T {i}"} for i in ids]}) + "\n")

    def page(collection, name, *ids):
        at = tmp_path / "pages" / f"collection_id={collection}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(json.dumps({"title": "p", "pagination": {"current": 1}, "results": [{"id": i, "url": f"u/{i}"} for i in ids]}) + "\n")

    def run():
        for q in K.ingest_collections(spark, listings, pages, table, ckpt):
            RN.run(q)
        return {k: sorted(map(tuple, df.collect())) for k, df in {"links": K.ingested(spark, table)["links"].select("collection_id", "item_id"),
                                                                  "items": K.ingested(spark, table)["items"].select("id", "url"),
                                                                  "collections": K.ingested(spark, table)["collections"].select("id", "title")}.items()}

    listing("1", "c1")
    page("c1", "1", "x", "y", "x")
    page("c2", "1", "y", None)
    first = run()
    assert first == {"links": [("c1", "x"), ("c1", "y")], "items": [("x", "u/x"), ("y", "u/y")], "collections": [("c1", "T c1")]}
    listing("2", "c1", "c2", "c3")  # c2's listing comes late, c1 comes again, c3 is empty
    page("c1", "2", "y", "z")
    second = run()
    assert second == {"links": [("c1", "x"), ("c1", "y"), ("c1", "z"), ("c2", "y")], "items": [("x", "u/x"), ("y", "u/y"), ("z", "u/z")],
                      "collections": [("c1", "T c1"), ("c2", "T c2"), ("c3", "T c3")]}
    assert run() == second


def test_backlog_follows_the_clock(spark, tmp_path):
    landing, results, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "id string, url string, kind string, at timestamp"
    t = dt.datetime(2024, 1, 1, 12)
    minutes = lambda m: t + dt.timedelta(minutes=m)
    log = []

    def step(*events):
        log.extend(events)
        spark.createDataFrame(list(events), schema).write.mode("append").parquet(landing)
        RN.run(K.watch_backlog(spark.readStream.schema(schema).parquet(landing), results, ckpt))
        now = max(e[3] for e in log)
        got = {r["id"] for r in K.backlog(spark, results).collect()}
        fetched = {e[0] for e in log if e[2] == "fetched"}
        items = spark.createDataFrame([(e[0], e[1], "{}" if e[0] in fetched else None) for e in log if e[2] == "found"], "id string, url string, api string")
        failures = spark.createDataFrame([(e[0], e[3]) for e in log if e[2] == "failed"], "item_id string, failed_at timestamp").groupBy("item_id").agg(F.max("failed_at").alias("failed_at"))
        want = {r["id"] for r in I.fetch_backlog(items, failures, F.lit(now)).collect()}
        assert got == want, (got, want)
        return got

    assert step(("a", "https://x/item/a", "found", minutes(0)), ("b", "https://x/item/b", "found", minutes(0)), ("r", "https://x/resource/r", "found", minutes(0))) == {"a", "b"}
    assert step(("a", None, "failed", minutes(1)), ("", None, "clock", minutes(5))) == {"b"}
    assert step(("a", None, "failed", minutes(50)), ("", None, "clock", minutes(70))) == {"b"}  # failed again: the first hour does not count
    assert step(("b", None, "fetched", minutes(80)), ("", None, "clock", minutes(109))) == set()
    assert step(("", None, "clock", minutes(111))) == {"a"}
