import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def test_queries_are_complete():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 180


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "score_mean" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_rows_of_one_split_are_spread(spark):
    from lintlake.catalog import bindings
    from lintlake.catalog.core import Tables

    for binding in (bindings.code_files, bindings.files, bindings.html_files):
        assert binding(Tables(spark, SF)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_scan_counts_every_script_rule_that_has_sql():
    assert "react-missing-key" in entry_module.oracle_sql()["U01_scan_rule_counts"]
