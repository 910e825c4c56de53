import io
from contextlib import redirect_stdout

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cross_joins_and_pruned_scans(spark):
    q = E.queries()
    for name in ["find_quotations", "sentence_languages", "backlog_gate", "key_audit", "fk_audit"]:
        plan = _plan(q[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    flagship = _plan(q["find_quotations"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in flagship
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in flagship
