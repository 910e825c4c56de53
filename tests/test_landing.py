"""Landed input of the stream queries: files and micro-batches follow the input's size, not its keys."""

import collections

from pyspark.sql import functions as F

from scholia.plans import catalog  # noqa: F401  (first: it imports q_stream)
from scholia.plans import q_stream as QS


def test_landed_files_are_even_whatever_the_keys(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("string").alias("item_id"), F.lit(0).alias("page_seq"), F.col("id").cast("string").alias("text"))
    files = QS._land_parquet(rows, str(tmp_path / "in"), "page_seq")
    back = spark.read.parquet(str(tmp_path / "in"))
    counts = collections.Counter(r[0] for r in back.select(F.input_file_name()).collect())
    assert files == 8 and back.select("text").distinct().count() == 4000
    assert max(counts.values()) <= 4000 / 8 + 8, counts  # all rows have one key: they were one file before


def test_second_landing_is_dealt_otherwise(spark, tmp_path):
    rows = spark.range(900).select(F.concat(F.lit("doc/"), "id").alias("item_id"), F.lit(0).alias("page_seq"), F.lit("x").alias("text"))
    for name, key in (("1", "item_id"), ("2", F.reverse("item_id"))):
        assert QS._land_parquet(rows, str(tmp_path / name), key) >= QS.FILES
    parts = [{r["item_id"]: r["landing"] for r in spark.read.parquet(str(tmp_path / n)).collect()} for n in "12"]
    assert [len(p) for p in parts] == [900, 900] and all(min(collections.Counter(p.values()).values()) > 200 for p in parts) and parts[0] != parts[1]


def test_result_pages_land_in_few_files_and_batches(spark, tmp_path):
    where = str(tmp_path / "pages")
    pages = spark.range(0, 2000, 1, 16).select(F.concat(F.lit("c"), F.col("id") % 10).alias("collection_id"), F.col("id").cast("string").alias("value"))
    QS._land_pages(pages, where)
    back = spark.read.text(where)
    assert back.count() == 2000 and len(back.inputFiles()) == 10  # a file for each collection, not for each task and collection
    assert QS._files_per_batch(spark, where) == 20 * QS.FILES
    many = str(tmp_path / "many")
    spark.range(300).select(F.col("id").cast("string").alias("value")).repartition(150).write.text(many)
    n = len(spark.read.text(many).inputFiles())
    assert n > 100 and QS._files_per_batch(spark, many) == -(-n // QS.LANDINGS)
