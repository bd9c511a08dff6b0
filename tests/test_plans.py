"""Physical plans have the shape that holds on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from listweave.operators import arrival, incremental
from listweave.schemas import JOB_LISTING
from listweave.sources.store import Store

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["collect_recent", "collect_prefix", "relevance_rank"]
)
def test_caps_prune_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


def test_large_cap_has_no_window_over_a_whole_group(spark):
    text = plan(entry.queries()["collect_large_cap"](spark, SF_DIR))
    assert "_part" in text and "BroadcastHashJoin" in text


def test_append_is_an_anti_join_on_the_key_column(spark, tmp_path):
    store = Store(str(tmp_path / "s"), JOB_LISTING)
    row = spark.range(3).select(*[F.col("id").cast("string").alias(n) for n in JOB_LISTING.names])
    store.write(row, "r1")
    new = incremental.unseen(row, store.keys(spark, "r2"), "job_id", ["title"])
    text = plan(new)
    assert "LeftAnti" in text
    scans = [line for line in text.splitlines() if "FileScan" in line]
    # Of the stored run only the key index is read.
    assert len(scans) == 1 and "struct<key:string,run:string,part:string>" in scans[0]
    assert "title" not in scans[0] and "IsNotNull(key)" in scans[0]


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["relevance_rank"](spark, SF_DIR))
    assert "n_chars" not in text
    text = plan(entry.queries()["facet_filter"](spark, SF_DIR))
    assert "PushedFilters: [In(o_orderstatus" in text or "In(o_orderpriority" in text
    assert "o_totalprice" not in text


def test_first_seen_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "k string, at int")
    assert "partial_min_by" in plan(arrival.first_seen(df.withColumn("v", F.lit(1)), ["k"], ["at"]))


def test_relevance_keeps_text_out_of_the_shuffle(spark):
    text = plan(entry.queries()["relevance_rank"](spark, SF_DIR))
    window = text[: text.index("Exchange")]
    assert "text#" not in window
