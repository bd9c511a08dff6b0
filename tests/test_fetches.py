from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listweave.plans.job_run import collect_jobs, ends_fetch, is_exempt
from listweave.schemas import JOB_LISTING, RAW_PAGES
from listweave.sources.store import Store
from listweave.streaming.fetches import OpenPages, WholeFetch
from listweave.streaming.incremental import start_incremental, take_open
from test_runs import api, state

NOW = datetime(2026, 3, 30, 12)
SIZE = 3


def page(query, number, *keys, hour=0, days=0.0, origin="api"):
    if origin == "state":
        body = [state(k, days_ago=days) for k in keys]
    else:
        body = [api(k, days_ago=days) for k in keys]
        for level in ("results", "visitorJobSearchV1", "universalSearchNuxt", "search", "data"):
            body = {level: body}
    when = NOW + timedelta(hours=hour)
    return ("upwork", query, len(query), origin, number, json.dumps(body), when)


class Stream:
    def __init__(self, spark, path, whole=None, **limits):
        self.spark, self.folder = spark, str(path / "landed")
        self.store = Store(str(path / "store"), JOB_LISTING)
        self.checkpoint = str(path / "checkpoint")
        self.whole = whole or WholeFetch(ends_fetch(SIZE), exempt=is_exempt())
        self.limits = {"count": None, "days": None, **limits}

    def listings(self, pages):
        return collect_jobs(pages, as_of=NOW, page_size=SIZE, **self.limits)

    def land(self, *pages):
        df = self.spark.createDataFrame(list(pages), RAW_PAGES)
        df.coalesce(1).write.mode("append").parquet(self.folder)

    def run(self):
        stream = self.spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", 1)
        start_incremental(
            stream.parquet(self.folder), self.listings, self.store, self.checkpoint,
            ["query_pos", "rank"], whole=self.whole,
        ).awaitTermination()
        return self.stored()

    def stored(self):
        return sorted(r.job_id for r in self.store.read(self.spark).collect())

    def open(self):
        like = self.spark.createDataFrame([], RAW_PAGES)
        return sorted((r["query"], r.page_no) for r in OpenPages(self.spark, self.checkpoint).now(like).collect())

    def batch(self):
        pages = self.spark.read.schema(RAW_PAGES).parquet(self.folder)
        return sorted(r.job_id for r in self.listings(pages).collect())


def test_a_fetch_over_three_batches_is_one_run(spark, tmp_path):
    """Cap and cutoff see the fetch as a whole: by file each page would have a cap of its own."""
    stream = Stream(spark, tmp_path, count=5, days=3)
    stream.land(page("x", 2, "g"), page("x", 0, "state", origin="state"))
    stream.land(page("x", 0, "a", "b", "c"), page("y", 0, "y1", "y2", "y3"))
    stream.land(page("x", 1, "d", "e", "f"), page("y", 1, "y4", days=9.0))
    assert stream.run() == stream.batch() == ["a", "b", "c", "d", "state", "y1", "y2", "y3"]
    assert stream.open() == []
    # Both queries became whole with the last file, so they are one run.
    assert len(stream.store.state(spark).parts) == 1


def test_pages_wait_over_runs_of_the_stream(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.land(page("x", 0, "a", "b", "c"), page("x", 0, "a", "b", "c"))
    assert stream.run() == [] and stream.open() == [("x", 0), ("x", 0)]
    stream.land(page("x", 2, "g"))
    assert stream.run() == []
    stream.land(page("x", 1, "d", "e", "f"))
    assert stream.run() == list("abcdefg") and stream.open() == []


def test_a_later_whole_fetch_closes_an_earlier_one(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.land(page("x", 0, "a", "b", "c"), page("y", 0, "y1", "y2", "y3"))
    stream.land(page("x", 0, "a2", hour=1))
    assert stream.run() == ["a", "a2", "b", "c"] and stream.open() == [("y", 0)]
    take_open(
        spark.createDataFrame([], RAW_PAGES), stream.listings, stream.store, stream.checkpoint,
        ["query_pos", "rank"],
    )
    assert stream.stored() == ["a", "a2", "b", "c", "y1", "y2", "y3"] and stream.open() == []


def test_patience_ends_a_fetch(spark, tmp_path):
    whole = WholeFetch(ends_fetch(SIZE), exempt=is_exempt(), patience="2 HOURS")
    stream = Stream(spark, tmp_path, whole)
    stream.land(page("x", 0, "a", "b", "c"))
    stream.land(page("y", 0, "y1", "y2", "y3", hour=1))
    assert stream.run() == []
    stream.land(page("z", 0, "z1", "z2", "z3", hour=3))
    assert stream.run() == ["a", "b", "c"] and stream.open() == [("y", 0), ("z", 0)]


@pytest.mark.parametrize("when", ["before the store", "after the store"])
def test_a_repeated_batch_finds_the_same_pages(spark, tmp_path, monkeypatch, when):
    stream = Stream(spark, tmp_path)
    stream.land(page("x", 0, "a", "b", "c"))
    stream.run()
    stream.land(page("x", 1, "d"))
    plain = OpenPages.leave

    def broken(*args):
        raise RuntimeError("lost")

    target = (Store, "append_new") if when == "before the store" else (OpenPages, "leave")
    with monkeypatch.context() as patch:
        patch.setattr(*target, broken)
        with pytest.raises(Exception, match="lost"):
            stream.run()
    assert OpenPages.leave is plain
    assert stream.run() == list("abcd") and stream.open() == []


def test_split_of_nothing(spark):
    pages = spark.createDataFrame([], RAW_PAGES)
    done, still_open = WholeFetch(F.lit(True)).split(pages)
    assert done.collect() == still_open.collect() == []
