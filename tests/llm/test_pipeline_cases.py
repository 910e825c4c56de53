"""The pipeline on tables with nulls, repeats, clashing names, and no rows."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def _tables(spark, path, docs):
    d = "/root/testdata/sf0.001"
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = some.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    odd = odd.union(some.limit(1).withColumn("text", F.lit("")))
    rows = some.union(some.limit(20)).union(odd).withColumn("key", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("row_0", F.lit("x"))
    path = _tables(spark, tmp_path / "t", rows)
    before, kept = rows, None
    docs = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == rows.columns, name
        docs = corpus_pipeline.keep(out, name)
        kept = docs.count()
        assert kept <= before.count()
        before = docs
    ids = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["text"]]
    assert len(ids) == len(set(ids)) and kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert mixed.count() == kept


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path / "e", docs)).count() == 0
