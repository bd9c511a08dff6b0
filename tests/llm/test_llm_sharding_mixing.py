from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_rows import edge_documents, empty_documents

from listweave.llm import mixing, sharding

SF_DIR = "/root/testdata/sf0.01"


def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = sharding.sharded(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert sorted(map(tuple, sharding.sharded(docs).collect())) == sorted(map(tuple, rows))


def test_shard_edges(spark):
    docs = edge_documents(spark)
    rows = sharding.sharded(docs, shards=3).collect()
    assert len(rows) == docs.count()
    empty = [r for r in rows if r["doc_id"] in (4, 5)]
    assert [(r["size"], r["text_crc32"]) for r in empty] == [(16, 0), (16, 0)]
    same = {r["virtual_slot"] for r in rows if r["doc_id"] == 2}
    assert len(same) == 1
    assert sharding.sharded(empty_documents(spark)).count() == 0


def test_map_versions_and_edits(spark, tmp_path):
    rng = np.random.default_rng(3)
    stats = [sharding.SlotStats(i, int(b), 2) for i, b in enumerate(rng.integers(50, 500, 400))]
    first = sharding.spread_slots(stats, 8)
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.write(1, first, stats)
    grown = sharding.rebalanced(store.shards(1), stats, 9)
    store.write(2, grown, stats)
    assert store.shards(1) == first and store.shards(2) == grown
    # The new shard gets its share, and records only move into it or to even out sizes.
    size = {s.slot: s.bytes for s in stats}
    load = Counter()
    for slot, shard in grown.items():
        load[shard] += size[slot]
    assert len(load) == 9 and max(load.values()) - min(load.values()) <= 500
    moved = [s for s in grown if grown[s] != first[s]]
    assert len(moved) < len(grown) / 3
    # Most moves fill the new shard, the rest even out sizes.
    assert sum(grown[s] == 8 for s in moved) > 0.75 * len(moved)


def test_a_stored_map_is_edited(spark, tmp_path):
    """More rows and one more shard: the next version moves few slots."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    folder = str(tmp_path / "map")
    first = sharding.sharded(docs.filter("doc_id % 5 <> 0"), 8, folder=folder).collect()
    again = sharding.sharded(docs, 9, folder=folder).collect()
    assert {r["map_version"] for r in first} == {1} and {r["map_version"] for r in again} == {2}
    before = {r["virtual_slot"]: r["shard"] for r in first}
    after = {r["virtual_slot"]: r["shard"] for r in again}
    assert sum(after[s] != before[s] for s in before) < len(before) / 3
    load, places = Counter(), {}
    for r in again:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert len(load) == 9 and max(load.values()) - min(load.values()) <= max(r["size"] for r in again)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def plain_targets(words, weights):
    total, capped = float(sum(words)), set()
    while True:
        free = [i for i in range(len(words)) if i not in capped]
        rest = total - sum(3 * words[i] for i in capped)
        t = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if t[i] > 3 * words[i]}
        if not over:
            return [float(3 * words[i]) if i in capped else t[i] for i in range(len(words))]
        capped |= over


@pytest.mark.parametrize(
    "words", [[100, 100, 100], [1000, 1, 1], [5], [0, 10, 3, 50], [900, 10, 20, 5, 5, 70, 3000]]
)
def test_targets(words):
    weights = [1 + i % 3 for i in range(len(words))]
    got = mixing.targets(words, weights)
    assert got == pytest.approx(plain_targets(words, weights))
    assert sum(got) == pytest.approx(sum(words))


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    read = {r["doc_id"]: r for r in docs.select("doc_id", "text", "source").collect()}
    rows = mixing.mixed(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(read)
    names = sorted({r["source"] for r in read.values()})
    words = Counter()
    for r in read.values():
        words[r["source"]] += len(r["text"].encode().split())
    wanted = dict(
        zip(
            names,
            plain_targets([words[n] for n in names], [1 + i % 3 for i in range(len(names))]),
            strict=True,
        )
    )
    taken, smallest = Counter(), {}
    for r in rows:
        source = read[r["doc_id"]]["source"]
        assert r["size"] == len(read[r["doc_id"]]["text"].encode().split())
        assert r["source_size"] == words[source]
        assert r["target"] == pytest.approx(wanted[source])
        assert r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"]
        taken[source] += r["taken"]
        smallest[source] = min(smallest.get(source, 1 << 30), r["size"])
    for name in names:
        assert abs(taken[name] - wanted[name]) <= 0.01 * wanted[name] + 50
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == sorted(map(tuple, rows))


def test_mixed_documents_follow_the_report(spark):
    docs = edge_documents(spark)
    report = Counter()
    for r in mixing.mixed(docs).collect():
        report[r["doc_id"]] += r["repeats"]
    stream = mixing.mixed_documents(docs, shards=3)
    assert stream.columns == docs.columns
    assert Counter(r["doc_id"] for r in stream.collect()) == +report
    nulls = [r for r in mixing.mixed(docs).collect() if r["doc_id"] in (4, 5, 6)]
    assert all(r["size"] == r["taken"] == 0 for r in nulls)
    assert mixing.mixed(empty_documents(spark)).count() == 0
    assert mixing.mixed_documents(empty_documents(spark)).count() == 0


def test_tree_splits_exactly():
    quotas = np.array([1000, 17, 0, 333, 5])
    shares = mixing.split_tree(quotas, 7, 1)
    assert (shares.sum(axis=0) == quotas).all() and (shares >= 0).all()
    sizes = shares.sum(axis=1)
    assert sizes.max() - sizes.min() <= 2
    assert (shares == mixing.split_tree(quotas, 7, 1)).all()
    # Over many seeds a shard's share of a source is its mean.
    mean = np.mean([mixing.split_tree(quotas, 7, s)[:, 3] for s in range(200)], axis=0)
    assert np.abs(mean - 333 / 7).max() < 3
