from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listweave.operators.arrival import first_seen
from listweave.schemas import RAW_PAGES
from listweave.plans.job_run import collect_jobs
from listweave.schemas import JOB_LISTING
from listweave.sources.store import Store
from listweave.streaming.incremental import deduplicated_within, start_incremental
from test_runs import api, landed, state

NOW = datetime(2026, 3, 30, 12)


def test_only_new_files_and_only_new_keys(spark, tmp_path):
    folder, store = str(tmp_path / "landed"), Store(str(tmp_path / "store"), JOB_LISTING)

    def land(runs):
        pages = landed(spark, runs).selectExpr("'upwork' source", "*", "timestamp'2026-03-30' fetched_at")
        pages.coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(RAW_PAGES).parquet(folder)
        start_incremental(
            stream,
            lambda pages: collect_jobs(pages, 10, None, NOW, page_size=3),
            store,
            str(tmp_path / "checkpoint"),
            ["query_pos", "rank"],
        ).awaitTermination()
        return sorted((r.job_id, r.run_id) for r in store.read(spark).collect())

    land({"x": ([state("S")], [[api("A"), api("B")]]), "y": (None, [[api("A")]])})
    first = run()
    assert [key for key, _ in first] == ["A", "B", "S"]
    assert run() == first
    land({"x": (None, [[api("B"), api("C")]])})
    second = run()
    assert set(first) < set(second) and [key for key, _ in second] == ["A", "B", "C", "S"]


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("q", str(i % 25), i) for i in range(60)]
    schema = "query string, job_id string, pos int"
    for start in (0, 20, 40):
        part = spark.createDataFrame(rows[start : start + 20], schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    store = Store(str(tmp_path / "store"), StructType.fromDDL("job_id string, query string"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_incremental(
        stream,
        lambda batch: first_seen(batch, ["query", "job_id"], ["pos"]),
        store,
        str(tmp_path / "checkpoint"),
        ["pos"],
    ).awaitTermination()
    batch = first_seen(spark.createDataFrame(rows, schema), ["query", "job_id"], ["pos"])
    got = store.read(spark)
    assert got.select("run_id").distinct().count() > 1
    expected = batch.select("job_id", "query").collect()
    assert sorted(got.select("job_id", "query").collect()) == sorted(expected)


def test_streams_into_one_store_keep_each_other(spark, tmp_path):
    store = Store(str(tmp_path / "store"), StructType.fromDDL("job_id string, query string"))
    schema = "query string, job_id string, pos int"
    for name, keys in (("one", "abc"), ("two", "cd")):
        folder = str(tmp_path / name)
        rows = [("q", key, i) for i, key in enumerate(keys)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        start_incremental(
            spark.readStream.schema(schema).parquet(folder),
            lambda batch: batch,
            store,
            str(tmp_path / f"checkpoint-{name}"),
            ["pos"],
        ).awaitTermination()
    assert sorted(r.job_id for r in store.read(spark).collect()) == list("abcd")


def test_bounded_dedup(spark, tmp_path):
    rows = [("a", "2026-03-30 10:00:00"), ("a", "2026-03-30 10:05:00"), ("b", "2026-03-30 10:01:00")]
    df = spark.createDataFrame(rows, "job_id string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        deduplicated_within(stream, ["job_id"], "at", "1 hour")
        .writeStream.format("memory").queryName("bounded").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.awaitTermination()
    assert sorted(r.job_id for r in spark.table("bounded").collect()) == ["a", "b"]
