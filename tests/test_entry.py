import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["job_id", "item_id", "reference_id", "verse_id", "probability"]
    assert df.count() >= 0


def test_every_query_registered_and_oracles_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 50
    assert all(isinstance(v, str) and v.strip() for v in s.values())


def test_small_queries_run(spark):
    from tests.conftest import SF_SMALL
    for name in ["job_status", "items_status", "page_text", "year_variants", "key_audit"]:
        assert E.queries()[name](spark, SF_SMALL).count() >= 0
