from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from listweave.session import local_session  # noqa: E402


# Columns can only be named once a session runs, so it starts before the test modules load.
SESSION = local_session("4", shuffle_partitions=2)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def value_of(spark):
    """Values of a column expression over text inputs ``a``, ``b``, ``c``."""

    def run(expression, *rows):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        names = "abcd"[: len(rows[0])]
        schema = ", ".join(f"{n} string" for n in names) + ", i int"
        df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return run
