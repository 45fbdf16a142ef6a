from __future__ import annotations

import __spark_entry__ as e


def test_entry_gives_rows(spark):
    df = e.entry(spark)
    assert df.columns == ["conv_id", "keywords", "n_pages"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 69


def test_workers_find_the_package(spark):
    e.queries()["page_count"](spark, e.SMALL).count()
    assert e.HERE in spark.sparkContext.environment["PYTHONPATH"].split(":")
