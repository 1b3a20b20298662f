import pytest
from foliomill.plans import catalog

import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert oracle.difference(spark, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lang", "quality", "requires_review", "documents"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, capsys):
    spark.read.parquet(f"{oracle.DATA}/documents.parquet").where("lang = 'en'").groupBy("source").count().explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(lang,en)" in plan and "struct<lang:string,source:string>" in plan


def test_no_row_at_a_time_python(spark, capsys):
    for name in ("document_quality_gate", "token_blocks", "table_class", "context_promotion", "repeated_graphics"):
        QUERIES[name](spark, oracle.DATA).explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
