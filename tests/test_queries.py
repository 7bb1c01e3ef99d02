"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import pytest

from conftest import same_rows
from gradeloom.plans import evaluation_queries, retrieval_queries, source_queries, text_queries

QUERIES = evaluation_queries.QUERIES | retrieval_queries.QUERIES | text_queries.QUERIES | source_queries.QUERIES
SQL = evaluation_queries.ORACLE_SQL | retrieval_queries.ORACLE_SQL | text_queries.ORACLE_SQL | source_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same_rows(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["subset", "n", "n_error", "n_correct", "error_acc", "correct_acc", "f1"] and df.count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["early_stop_trace"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and plan.count("Exchange hashpartitioning") == 1
