import glob
import os

import duckdb
import pytest

from ragmill.llm import queries

COLUMNS = {
    "p1_found": {"table_name", "key_a", "key_b"}, "p2_found": {"rec_no", "line_no", "kind"}, "p3_found": {"rec_no", "line_no"}, "p4_found": {"rec_no", "kind"},
    "p5_found": {"in_no", "batch_no"}, "p6_found": {"item_a", "item_b"}, "p7_ids": {"doc_id", "ids"}, "p8_found": {"doc_id"}, "p9_found": {"doc_a", "doc_b"},
}


def values(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    assert COLUMNS.get(name, set(got.columns)) == set(got.columns)
    if name in queries.SQL:
        db = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        assert values(got) == values(db.execute(queries.SQL[name]).df())


def test_no_step_of_any_query_pairs_all_rows(spark, data, monkeypatch):
    import re

    from ragmill import session
    from ragmill.llm import boilerplate, history, knn, lookalikes, neardup, packing, pages

    seen = []

    def watched(df, name):
        text = df._jdf.queryExecution().executedPlan().toString()
        seen.append(name)
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), name
        return session.materialise(df, name)

    for module in (boilerplate, history, knn, lookalikes, neardup, packing, pages):
        monkeypatch.setattr(module, "materialise", watched)
    for name in ("p1_groups", "p2_found", "p3_cleaned", "p5_found", "p6_found", "p8_bins", "p9_found"):
        df = queries.QUERIES[name](spark, data)
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", df._jdf.queryExecution().executedPlan().toString()), name
    assert len(seen) > 20
