"""Every registered query with SQL gives the rows that DuckDB gives."""

import oracle
import pytest

import __spark_entry__
from tessera.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, name):
    only_here, only_there, _ = oracle.differences(plans.QUERIES[name](spark, FOLDER), plans.SQL[name], FOLDER)
    assert not only_here and not only_there


def test_queries_without_sql(spark):
    found = {n: plans.QUERIES[n](spark, FOLDER).collect() for n in ("eval_schema", "snippet_check", "capabilities", "doctor")}
    assert all(found.values())
    assert [(r.snippet, r.line, r.col) for r in found["snippet_check"] if r.snippet == 2] == [(2, 2, 3)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["name", "kind", "file", "ord", "total", "truncated"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
