from __future__ import annotations

import os
from collections import Counter

import pytest
from edge_rows import edge_documents, empty_documents
from test_llm_decontam import brute as brute_hits
from test_llm_simhash import plain_components, plain_fingerprint

import __spark_entry__ as entry
import corpus_pipeline
from listweave.llm import mixing, quality
from listweave.session import pinned, shared_dir

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(pinned(stage(spark, tables[-1], SF_DIR)))
    return tables


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r["doc_id"] for r in quality.quality_report(stages[0], labels).collect() if r["kept"]}
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if i in kept}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good)


def test_simhash_stage(stages):
    before = texts(stages[1])
    groups = plain_components({i: plain_fingerprint(t) for i, t in before.items()}, 3)
    assert texts(stages[2]) == {i: t for i, t in before.items() if groups[i] == i}


def test_decontamination_stage(spark, stages):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    assert before.keys() == after.keys()
    hits = {r[0]: r[2] for r in brute_hits(list(before.items()), bench)}
    assert any(hits.values())
    assert all(after[i] == before[i] for i in before if not hits[i])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())
    left = {r[0]: r for r in brute_hits(list(after.items()), bench)}
    for i, n in hits.items():
        if n:
            assert left[i][1] == brute_hits([(i, before[i])], bench)[0][1] - n


def test_mixing_and_sharding_stages(stages):
    report = Counter()
    for r in mixing.mixed(stages[3]).collect():
        report[r["doc_id"]] += r["repeats"]
    assert Counter(r["doc_id"] for r in stages[4].select("doc_id").collect()) == +report
    assert Counter(r["doc_id"] for r in stages[5].collect()) == +report
    load = Counter()
    for r in stages[5].collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 40
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in stages[5].collect())


def test_runs_keep_their_results(spark, stages):
    """A later run takes nothing away from an earlier one, read in either order."""
    first, second = (corpus_pipeline.run(spark, SF_DIR) for _ in range(2))
    expected = sorted(map(tuple, stages[5].collect()))
    assert sorted(map(tuple, second.collect())) == expected
    assert sorted(map(tuple, first.collect())) == expected
    assert "pipeline" in entry.queries()
    assert len([n for n in entry.queries() if n.startswith("op")]) == 13


def test_a_written_run_leaves_nothing_else(spark, stages, tmp_path):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.written(spark, SF_DIR, str(tmp_path / "out"))
    assert rows.count() == stages[5].count()
    assert set(os.listdir(folder)) == before


def test_edges(spark):
    docs = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = pinned(stage(spark, docs, SF_DIR))
        assert docs.count() > 0, name


def test_empty_table(spark):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = pinned(stage(spark, docs, SF_DIR))
        assert docs.count() == 0
