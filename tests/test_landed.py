from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from listweave.plans.job_run import collect_jobs
from listweave.schemas import RAW_PAGES
from listweave.sources import landed
from test_runs import NOW, api, landed as landed_rows, state

T1, T2 = datetime(2026, 3, 30, 10, 0, 0, 5), datetime(2026, 3, 31)
ROWS = [
    ("upwork", "a b/c_d~.", 0, "api", 0, "[1]\n é", T1),
    ("upwork", "a b/c_d~.", 0, "api", 1, "", T1),
    ("upwork", "other", 1, "state", 0, "x" * 3000, T2),
    ("linkedin", "other", None, None, None, "card", None),
    (None, "other", 2, "api", 7, "y", T2),
]


@pytest.fixture
def folder(spark, tmp_path):
    landed.register(spark)
    df = spark.createDataFrame([*ROWS, ROWS[0]], RAW_PAGES).repartition(2)
    path = str(tmp_path / "landing")
    df.write.format("landed_pages").mode("append").save(path)
    return path


def read(spark, folder):
    return spark.read.format("landed_pages").load(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pages_come_back_once(spark, folder):
    assert rows(read(spark, folder)) == sorted(ROWS, key=repr)
    assert read(spark, folder).schema == spark.createDataFrame([], RAW_PAGES).schema
    assert rows(read(spark, folder + "-absent")) == []


@pytest.mark.parametrize("test", [
    "query = 'other'", "query IN ('a b/c_d~.', 'none')", "source = 'upwork' AND query = 'other'",
    "fetched_at > timestamp'2026-03-30 12:00:00'", "fetched_at <= timestamp'2026-03-30 10:00:00.000005'",
    "source <=> NULL", "origin = 'api'", "query = 'other' OR page_no = 1", "fetched_at IS NULL",
])
def test_filters_give_what_spark_gives(spark, folder, test):
    plain = spark.createDataFrame(ROWS, RAW_PAGES)
    assert rows(read(spark, folder).filter(test)) == rows(plain.filter(test))


def test_filters_decide_which_folders_are_listed(folder, monkeypatch):
    reader = landed.LandedReader(folder)
    tests = [
        landed.EqualTo(("query",), "other"),
        landed.GreaterThanOrEqual(("fetched_at",), T2.replace(tzinfo=timezone.utc)),
    ]
    assert reader.pushFilters(tests) == tests
    found = [key for part in reader.partitions() for _, key in part.files]
    assert {(k[0], k[1]) for k in found} == {("upwork", "other"), (None, "other")}
    monkeypatch.setattr(landed, "PART_BYTES", 100)
    assert len(landed.LandedReader(folder).partitions()) > 2


def test_a_run_over_the_source_is_the_run_over_the_table(spark, tmp_path):
    landed.register(spark)
    pages = landed_rows(spark, {
        "x": ([state("S")], [[api("A"), api("B"), api("C")], [api("D")]]),
        "y": (None, [[api("A"), api("E", days_ago=9)]]),
    })
    table = pages.select(
        F.lit("upwork").alias("source"), "*", F.lit(T1).alias("fetched_at")
    ).select(*[f.split()[0] for f in RAW_PAGES.split(", ")])
    path = str(tmp_path / "landing")
    table.write.format("landed_pages").mode("append").save(path)

    def run(df):
        found = collect_jobs(df, 10, 3, NOW, page_size=3, stamp=F.lit(""))
        return rows(found)

    assert run(read(spark, path)) == run(table) != []
