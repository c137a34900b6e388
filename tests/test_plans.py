import re

import pytest

from ragmill import catalogue


def plan(spark, data, name):
    return catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith("rag_query")])
def test_no_cross_join_and_no_row_udf(spark, data, name):
    text = plan(spark, data, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_only_needed_columns_are_read(spark, data):
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan(spark, data, "vector_topk")
    assert "ReadSchema: struct<rec_no:bigint,content:string>" in plan(spark, data, "clean_page_numbers")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, data, "chunk_recursive")


def test_top_k_before_any_move(spark, data):
    text = plan(spark, data, "vector_topk_threshold")
    assert "TakeOrderedAndProject(limit=3" in text and "Exchange" not in text
    # The threshold stays above the limit: it must not change which rows are the top.
    assert text.index("Filter") < text.index("TakeOrderedAndProject")


def test_one_row_per_id_is_kept_before_the_shuffle(spark, data):
    from ragmill.session import table
    from ragmill.sources.collections import as_items, latest

    text = latest(as_items(table(spark, data, "vectors")))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(id.*\n.*WindowGroupLimit.*Partial", text)


def test_questions_do_not_pass_through_the_driver(spark, data, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("rows came to the driver")

    for name in ("collect", "toLocalIterator", "toPandas", "toArrow", "first", "head", "take"):
        monkeypatch.setattr(DataFrame, name, refuse)
    text = plan(spark, data, "vector_topk_batch")
    assert "Join" not in text and re.search(r"Exchange hashpartitioning\(qid.*\n.*WindowGroupLimit.*Partial", text)


def test_predicates_reach_the_scan(spark, data):
    assert "PushedFilters: [IsNotNull(query), Not(EqualTo(query,))]" in plan(spark, data, "questions_asked")
    assert "GreaterThanOrEqual(score,0.35)" in plan(spark, data, "search_threshold")
    assert "PushedFilters: [In(mimetype" in plan(spark, data, "mime_dispatch") or "EqualTo(mimetype" in plan(spark, data, "mime_dispatch")
