from __future__ import annotations

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry
from listweave.catalog import base

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


# Queries that run Python on the executors, and where: expressions on HTML, slices of W2.
HTML_STEPS = {"card_extract", "page_fields", "board_cards", "board_details", "board_run"}
ORDERED_STEPS = {"two_key_dedup", "two_key_turns", "job_run", "stream_fetches"}


@pytest.fixture
def python_steps(spark, monkeypatch):
    """Names of the methods that took a Python function, also in jobs that a query ran itself."""
    used = set()
    for owner, name in (
        (type(spark.range(0)), "mapInPandas"),
        (type(spark.range(0)), "mapInArrow"),
        (type(spark.range(0).groupBy("id")), "applyInPandas"),
        (type(spark.range(0).groupBy("id")), "applyInArrow"),
    ):
        plain = getattr(owner, name)

        def seen(self, *args, plain=plain, name=name, **options):
            used.add(name)
            return plain(self, *args, **options)

        monkeypatch.setattr(owner, name, seen)
    return used


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in base.QUERIES])
def test_query_equals_sql(spark, connection, python_steps, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in HTML_STEPS:
        assert "EvalPython" not in plan
    assert python_steps <= ({"applyInPandas"} if name in ORDERED_STEPS else set())
    names, rows = spark_rows(df)
    expected_names, expected = duck_rows(connection, entry.oracle_sql()[name])
    assert sorted(names) == sorted(expected_names)
    assert rows == expected
    assert rows


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query", "rank", "job_id"]
    assert df.take(1)
