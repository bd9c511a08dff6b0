from __future__ import annotations

import csv
import os
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.functions.times import older_than_time
from listweave.operators import incremental
from listweave.schemas import JOB_LISTING
from listweave.sources import store as store_module
from listweave.sources.commits import Commits
from listweave.sources.store import Store

ARRIVAL = ["query_pos", "rank"]
SCHEMA = "query string, query_pos int, rank int, job_id string, title string"


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in JOB_LISTING.names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(f"{name} text"))
    return df


def listings(spark, *ids, query="q"):
    return batch(spark, [(query, 0, i, key, f"t{key}") for i, key in enumerate(ids)])


@pytest.fixture(params=["parquet", "csv"])
def store(request, tmp_path):
    return Store(str(tmp_path / "deep" / "store"), JOB_LISTING, format=request.param)


def counts(df):
    return {r["query"]: (r.fetched, r.new, r.skipped) for r in df.collect()}


def stored(spark, store):
    return sorted(r.job_id for r in store.read(spark).collect())


def test_absent_store_has_no_ids(spark, store):
    assert store.ids(spark).collect() == []


def test_run_twice_writes_once(spark, store):
    for run, new in (("r1", 3), ("r2", 0), ("r3", 0)):
        got = counts(store.append_new(listings(spark, "a", "b", "c"), run, ARRIVAL))
        assert got == {"q": (3, new, 3 - new)}
    assert stored(spark, store) == ["a", "b", "c"]
    mixed = store.append_new(listings(spark, "b", "d"), "r4", ARRIVAL)
    assert counts(mixed) == {"q": (2, 1, 1)}
    assert stored(spark, store) == ["a", "b", "c", "d"]
    assert sorted(r.job_id for r in store.ids(spark).collect()) == ["a", "b", "c", "d"]


def test_repeated_run_replaces_its_own_attempt(spark, store):
    store.append_new(listings(spark, "a"), "r1", ARRIVAL)
    store.append_new(listings(spark, "b", "c"), "r2", ARRIVAL)
    again = store.append_new(listings(spark, "a", "c", "d"), "r2", ARRIVAL)
    assert counts(again) == {"q": (3, 2, 1)}
    assert stored(spark, store) == ["a", "c", "d"]


def test_nothing_new_leaves_no_folder(spark, store):
    store.append_new(listings(spark, "a"), "r1", ARRIVAL)
    assert counts(store.append_new(listings(spark, "a"), "r2", ARRIVAL)) == {"q": (1, 0, 1)}
    assert sorted(n for n in os.listdir(store.path) if n[0] not in "_.") == ["run_id=r1"]


def test_retry_without_anything_new_replaces_the_attempt(spark, store):
    store.append_new(listings(spark, "a"), "r1", ARRIVAL)
    store.write(listings(spark, "a", "b").select(*JOB_LISTING.names), "r2")
    assert counts(store.append_new(listings(spark, "a"), "r2", ARRIVAL)) == {"q": (1, 0, 1)}
    assert stored(spark, store) == ["a"]


def test_large_csv_is_taken_over_once(spark, tmp_path):
    old = Store(str(tmp_path / "old"), JOB_LISTING, format="csv")
    old.append_new(listings(spark, "a", "b"), "r1", ARRIVAL)
    new = Store(str(tmp_path / "new"), JOB_LISTING)
    assert new.take_over(old, spark, "import") == 2
    assert counts(new.append_new(listings(spark, "b", "c"), "r2", ARRIVAL)) == {"q": (2, 1, 1)}


def test_empty_batch_creates_nothing(spark, store):
    assert counts(store.append_new(listings(spark, "a").limit(0), "r1", ARRIVAL)) == {}
    assert not os.path.exists(store.path)


def test_repeated_keys_in_a_batch_are_written_once(spark, store):
    got = store.append_new(listings(spark, "a", "a", "b"), "r1", ARRIVAL)
    assert counts(got) == {"q": (3, 2, 1)}
    assert stored(spark, store) == ["a", "b"]


def test_empty_keys_are_no_duplicates(spark, store):
    for run in ("r1", "r2"):
        got = store.append_new(listings(spark, "", "", None, "a"), run, ARRIVAL)
        assert counts(got)["q"][1] == (4 if run == "r1" else 3)
    assert [r.job_id for r in store.ids(spark).collect()] == ["a"]


def test_first_query_owns_a_key(spark, store):
    rows = [("two", 1, 1, "a", "t2"), ("one", 0, 9, "a", "t1"), ("two", 1, 2, "b", "t")]
    got = store.append_new(batch(spark, rows), "r1", ARRIVAL)
    assert counts(got) == {"one": (1, 1, 0), "two": (2, 1, 1)}
    assert {(r.job_id, r.title) for r in store.read(spark).collect()} == {("a", "t1"), ("b", "t")}
    totals = counts(incremental.run_totals(got))
    assert totals == {"one": (1, 1, 0), "two": (2, 1, 1), "(all)": (3, 2, 1)}


AWKWARD = ['a,b "quoted"', "two\nlines", "", " padded\t", 'ends with \\', "é €", "'", '"']


def test_awkward_text_comes_back(spark, store):
    rows = [("q", 0, i, str(i), text) for i, text in enumerate(AWKWARD)]
    assert store.write(batch(spark, rows), "r1") == len(AWKWARD)
    back = {r.job_id: r.title for r in store.read(spark).collect()}
    assert back == {str(i): text for i, text in enumerate(AWKWARD)}


def test_columns_in_record_order_and_one_header(spark, tmp_path):
    store = Store(str(tmp_path / "s"), JOB_LISTING, format="csv")
    store.append_new(listings(spark, "a", "b").coalesce(1), "r1", ARRIVAL)
    lines = []
    for folder, _, names in os.walk(store.path):
        for name in names:
            if name.endswith(".csv"):
                with open(os.path.join(folder, name), encoding="utf-8") as text:
                    lines += text.read().splitlines()
    assert lines.count(",".join(JOB_LISTING.names)) == len({l for l in lines if l.startswith("job_id,")})
    assert len([l for l in lines if not l.startswith("job_id,")]) == 2
    assert store.read(spark).columns == [*JOB_LISTING.names, "run_id"]


def test_store_written_by_the_csv_module_is_taken_over(spark, tmp_path):
    store = Store(str(tmp_path / "s"), JOB_LISTING, format="csv")
    folder = tmp_path / "s" / "run_id=import"
    folder.mkdir(parents=True)
    with open(folder / "listings.csv", "w", newline="", encoding="utf-8") as target:
        writer = csv.DictWriter(target, fieldnames=JOB_LISTING.names)
        writer.writeheader()
        for i, text in enumerate(AWKWARD):
            writer.writerow({"job_id": str(i), "title": text, "scraped_at": "end"})
    rows = store.read(spark).collect()
    assert {r.job_id: r.title for r in rows} == {str(i): text for i, text in enumerate(AWKWARD)}
    assert {(r.scraped_at, r.url) for r in rows} == {("end", "")}
    assert counts(store.append_new(listings(spark, "1", "x"), "r1", ARRIVAL)) == {"q": (2, 1, 1)}


def test_two_writers_at_once_store_each_key_once(spark, store):
    """Both look at the same version; one of them is second and has to look again."""
    meet = threading.Barrier(2)

    class Late(Commits):
        def latest(self):
            state = super().latest()
            if state.version == 0 and threading.current_thread().name in waiting:
                waiting.discard(threading.current_thread().name)
                meet.wait(60)
            return state

    store.append_new(listings(spark, "a"), "r0", ARRIVAL)
    waiting = {"one", "two"}
    plain, store_module.Commits = store_module.Commits, Late
    found = {}

    def append(name, *ids):
        found[name] = counts(store.append_new(listings(spark, *ids), name, ARRIVAL))["q"]

    try:
        writers = [
            threading.Thread(target=append, name=name, args=(name, *ids))
            for name, ids in (("one", "abcd"), ("two", "acde"))
        ]
        for writer in writers:
            writer.start()
        for writer in writers:
            writer.join(240)
    finally:
        store_module.Commits = plain
    assert stored(spark, store) == list("abcde")
    # Whoever came first stored c and d, too.
    assert sorted([found["one"][1], found["two"][1]]) == [1, 3]
    assert store.state(spark).version == 2


def test_unlisted_writes_are_not_there(spark, store):
    store.append_new(listings(spark, "a"), "r1", ARRIVAL)
    # A writer that was killed before its commit: folder and keys are written.
    store._written(listings(spark, "b").select(*JOB_LISTING.names), "r2", store.state(spark))
    assert stored(spark, store) == ["a"]
    assert [r.job_id for r in store.ids(spark).collect()] == ["a"]
    assert counts(store.append_new(listings(spark, "b"), "r3", ARRIVAL)) == {"q": (1, 1, 0)}
    store.vacuumed(spark)
    assert stored(spark, store) == ["a", "b"]
    assert not os.path.exists(f"{store.path}/run_id=r2/")or not os.listdir(f"{store.path}/run_id=r2/")


def test_a_version_is_written_once(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    state = commits.latest()
    assert commits.add(state) and not commits.add(state)
    assert commits.latest().version == 0


def test_merged_runs_are_the_same_store(spark, store):
    for i, ids in enumerate(("ab", "bc", "cd")):
        store.append_new(listings(spark, *ids), f"r{i}", ARRIVAL)
    before = sorted((r.job_id, r.run_id) for r in store.read(spark).collect())
    store.compacted(spark)
    assert sorted((r.job_id, r.run_id) for r in store.read(spark).collect()) == before
    assert len(store.state(spark).parts) == 1
    store.vacuumed(spark)
    assert counts(store.append_new(listings(spark, "d", "e"), "r3", ARRIVAL)) == {"q": (2, 1, 1)}
    # A run that is repeated after it was merged takes the place of its rows.
    again = store.append_new(listings(spark, "a", "c", "f"), "r2", ARRIVAL)
    assert counts(again) == {"q": (3, 1, 2)}
    assert stored(spark, store) == ["a", "b", "c", "e", "f"]
    assert counts(store.append_new(listings(spark, "d"), "r5", ARRIVAL)) == {"q": (1, 1, 0)}


def test_a_small_batch_opens_few_key_files(spark, tmp_path):
    store = Store(str(tmp_path / "s"), JOB_LISTING)
    for run in range(3):
        ids = [f"k{run}-{i}" for i in range(400)]
        store.append_new(listings(spark, *ids), f"r{run}", ARRIVAL)
    state = store.state(spark)
    everything = store._known(spark, state, None, None)
    buckets = [r[0] for r in spark.createDataFrame([("k0-7",)], "k string").select(
        store_module._bucket(F.col("k"), state.buckets)).collect()]
    some = store._known(spark, state, buckets, None)
    assert everything.count() == 1200 and some.filter("job_id = 'k0-7'").count() == 1
    assert len(everything.inputFiles()) == 3 * state.buckets and len(some.inputFiles()) <= 3
    assert all("/_keys/" in name for name in everything.inputFiles())


def timed_rows(spark, *runs):
    rows = [
        (run, 0, i, f"{run}-{i}", "soon" if i % 9 == 0 else f"2026-03-{1 + i % 28:02d}T0{i % 10}:00:00")
        for run in runs
        for i in range(200)
    ]
    return spark.createDataFrame(rows, "query string, query_pos int, rank int, job_id string, at string")


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_newer_records_of_merged_and_other_parts(spark, tmp_path, format):
    record = T.StructType.fromDDL("job_id string, at string")
    store = Store(str(tmp_path / "s"), record, format=format, time="at", facets=("at",))
    for run in ("r0", "r1"):
        store.append_new(timed_rows(spark, run), run, ["rank"])
    as_of = datetime(2026, 3, 28)
    before = sorted(tuple(r) for r in store.newer(spark, as_of, 3).collect())
    store.compacted(spark, files=4)
    store.append_new(timed_rows(spark, "r2"), "r2", ["rank"])
    found = store.newer(spark, as_of, 3)
    assert sorted(tuple(r) for r in found.filter("run_id <> 'r2'").collect()) == before
    all_rows = store.read(spark)
    expected = all_rows.filter(~older_than_time(F.col("at"), as_of, 3))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert store.read(spark).columns == ["job_id", "at", "run_id"]


def test_old_row_groups_are_not_read(spark, tmp_path):
    record = T.StructType.fromDDL("job_id string, at string")
    store = Store(str(tmp_path / "s"), record, time="at", facets=("at",))
    store.append_new(timed_rows(spark, "r0").filter("at <> 'soon'"), "r0", ["rank"])
    store.compacted(spark, files=6)
    found = store.newer(spark, datetime(2026, 3, 28), 3)
    n = found.count()
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    scans = [node for node in seq(plan.collectLeaves()) if "_time" in node.toString()]
    read = sum(node.metrics().apply("numOutputRows").value() for node in scans)
    total = store.read(spark).count()
    assert 0 < n <= read <= total // 2
    assert "GreaterThanOrEqual(_time" in found._jdf.queryExecution().toString()


def seq(nodes):
    return [nodes.apply(i) for i in range(nodes.size())]
