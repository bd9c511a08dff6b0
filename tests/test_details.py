from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.sources.store import Store
from listweave.streaming.details import retry_open, start_details
from listweave.streaming.fetches import OpenPages

SCHEMA = "job_id string, payload string, fetched_at timestamp"
RECORD = T.StructType.fromDDL("job_id string, title string, level string, text string")
NOW = datetime(2026, 3, 30)


def parsed(pages):
    """A payload is the level and the text, parted by a slash."""
    parts = F.split("payload", "/")
    return pages.select("job_id", parts[0].alias("level"), parts[1].alias("text"))


class Details:
    def __init__(self, spark, path, format="parquet"):
        self.spark, self.folder = spark, str(path / "landed")
        self.store = Store(str(path / "store"), RECORD, format=format)
        self.checkpoint = str(path / "checkpoint")

    def listings(self, run, *ids):
        rows = [("q", i, key, f"t{key}", "", "") for i, key in enumerate(ids)]
        df = self.spark.createDataFrame(
            rows, "query string, pos int, job_id string, title string, level string, text string"
        )
        self.store.append_new(df, run, ["query", "pos"])

    def land(self, *rows):
        rows = [(key, payload, NOW + timedelta(hours=hour)) for key, payload, hour in rows]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.folder)
        start_details(stream, parsed, self.store, self.checkpoint).awaitTermination()

    def stored(self):
        rows = self.store.read(self.spark).collect()
        return sorted((r.job_id, r.title, r.level, r.text, r.run_id) for r in rows)

    def waiting(self):
        like = self.spark.createDataFrame([], SCHEMA)
        return sorted(r.job_id for r in OpenPages(self.spark, self.checkpoint).now(like).collect())


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_details_fill_records_whenever_they_land(spark, tmp_path, format):
    details = Details(spark, tmp_path, format)
    details.land(("c", "1/early", 0))
    assert details.stored() == [] and details.waiting() == ["c"]
    details.listings("r1", "a", "b")
    details.listings("r2", "c")
    retry_open(spark.createDataFrame([], SCHEMA), parsed, details.store, details.checkpoint)
    details.land(("a", "2/old", 1), ("a", "3/new", 2), ("a", "3/new", 2), ("x", "9/other", 0))
    assert details.stored() == [
        ("a", "ta", "3", "new", "r1"),
        ("b", "tb", "", "", "r1"),
        ("c", "tc", "1", "early", "r2"),
    ]
    assert details.waiting() == ["x"]
    # A later one replaces what it names and leaves the rest.
    details.land(("a", "/newest", 3))
    assert details.stored()[0] == ("a", "ta", "3", "newest", "r1")
    details.listings("r3", "a", "d")
    assert [r[0] for r in details.stored()] == ["a", "b", "c", "d"]


def test_only_parts_with_the_keys_are_written_anew(spark, tmp_path):
    details = Details(spark, tmp_path)
    for run, key in (("r1", "a"), ("r2", "b"), ("r3", "c")):
        details.listings(run, key)
    before = {p.run: p for p in details.store.state(spark).parts}
    details.land(("b", "5/text", 0))
    after = details.store.state(spark).parts
    assert {p for p in after if p.run is not None} == {before["r1"], before["r3"]}
    assert details.stored()[1] == ("b", "tb", "5", "text", "r2")
    # The run's rows can still be replaced as a whole.
    details.listings("r2", "b", "e")
    assert [(r[0], r[2]) for r in details.stored()] == [("a", ""), ("b", ""), ("c", ""), ("e", "")]


def test_a_repeated_batch_writes_the_same(spark, tmp_path, monkeypatch):
    details = Details(spark, tmp_path)
    details.listings("r1", "a")
    with monkeypatch.context() as patch:
        patch.setattr(OpenPages, "leave", lambda *args: 1 / 0)
        with pytest.raises(Exception, match="division"):
            details.land(("a", "5/text", 0), ("b", "6/other", 0))
    details.land()
    assert details.stored() == [("a", "ta", "5", "text", "r1")] and details.waiting() == ["b"]
