from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from edge_rows import edge_documents, empty_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from listweave.llm import components, simhash

SF_DIR = "/root/testdata/sf0.01"


def plain_fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_components(prints, 3)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i]["fingerprint"] == f"{prints[i]:016x}" for i in texts)
    assert all(got[i]["component_id"] == groups[i] for i in texts)
    assert len(set(groups.values())) < len(groups)


def test_bytes_lower_only_ascii():
    texts = ["É A b", "é A B", None, "", "one", "a b", "a b c d"]
    expected = [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(pa.array(texts), 3).tolist() == expected


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.data())
def test_near_cells_hold_all_links(values, data):
    changed = [
        v ^ sum(1 << b for b in data.draw(st.sets(st.integers(0, 63), max_size=3))) for v in values
    ]
    steps = set(simhash.steps_to_near_cells(3))

    def cell(v):
        return tuple((v >> s & 0xFFFF).bit_count() for s in (0, 16, 32, 48))

    for a, b in zip(values, changed, strict=True):
        step = tuple(y - x for x, y in zip(cell(a), cell(b), strict=True))
        assert step in steps or tuple(-s for s in step) in steps


def test_many_tiles_per_cell_give_the_same_roots(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    near = np.unique(np.concatenate([base, base ^ 1, base ^ 5, base ^ (1 << 40)]))
    prints = spark.createDataFrame([(int(v),) for v in near], "fp bigint")
    found = {
        rows: {r["node"]: r["root"] for r in simhash.fingerprint_components(prints, 3, rows).collect()}
        for rows in (2048, 2)
    }
    for roots in found.values():
        groups = plain_components({int(v): int(v) & (2**64 - 1) for v in near}, 3)
        assert len(set(roots.values())) == len(set(groups.values())) == 40
        assert all(
            (roots[a] == roots[b]) == (groups[a] == groups[b]) for a in roots for b in roots
        )


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    mixed = [(i, (i * 7919) % 500 + 3000) for i in range(3000, 3500)]
    links = [(a, b) for a, b in chain + star + mixed if a != b]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    roots = {r["node"]: r["root"] for r in components.components(df).collect()}
    parent = components.local_labels(
        4000, np.array([a for a, _ in links]), np.array([b for _, b in links])
    )
    nodes = {n for pair in links for n in pair}
    assert roots.keys() == nodes
    names = {}
    for n in nodes:
        assert names.setdefault(parent[n], roots[n]) == roots[n]
    assert len(set(names.values())) == len(names)


def test_edges(spark):
    got = simhash.simhash_groups(edge_documents(spark)).collect()
    assert len(got) == edge_documents(spark).count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[1] == [by[2][0]] and len(by[2]) == 2 and by[1][0][1] == 1
    assert by[4] == by[5] == by[6] == [("0" * 16, 4)]
    assert by[8] == by[9] and by[8][0][1] == 8
    alone = [c for f, c in by[None] if f != "0" * 16]
    assert alone == [None, None]
    assert simhash.simhash_groups(empty_documents(spark)).count() == 0
    assert simhash.simhash_documents(empty_documents(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = edge_documents(spark)
    kept = simhash.simhash_documents(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in (1, 3, 4, 7, 8, 10, 11, 12)] + [(True, 0)]


def test_large_group_of_near_copies(spark):
    words = prose(5, 400).split()
    rows = [(i, " ".join([*words, f"end{i % 60}"])) for i in range(300)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    groups = plain_components(prints, 3)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == groups


def test_pairs_of_near_tiles_come_in_bounded_pieces():
    rng = np.random.default_rng(2)
    bits = np.uint64(1) << rng.integers(0, 64, (600, 2)).astype(np.uint64)
    left = np.unique(np.bitwise_xor.reduce(bits, axis=1))
    right = left ^ np.uint64(1 << 7)
    for other, same in ((right, False), (left, True)):
        pieces = list(simhash.near_pairs(left, other, same, 3))
        assert len(left) * len(other) > simhash.CELLS_AT_ONCE
        assert len(pieces) > 1 and all(0 < len(a) <= simhash.CELLS_AT_ONCE for a, _ in pieces)
        got = sorted((int(a), int(b)) for p in pieces for a, b in zip(*p, strict=True))
        assert got == sorted(
            (a, b)
            for x, a in enumerate(left.tolist())
            for y, b in enumerate(other.tolist())
            if (a ^ b).bit_count() <= 3 and (not same or x < y)
        )


def test_no_task_has_two_python_workers(spark, monkeypatch):
    plans = []

    def noted(df, *args, write=components.pinned):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    for module in (simhash, components):
        monkeypatch.setattr(module, "pinned", noted)
    rows = [(v,) for v in (0, 1, 3, 1 << 40, (1 << 40) + 6, -1)]
    prints = spark.createDataFrame(rows, "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.fingerprint_components(prints, 3).collect()}
    assert len(roots) == 5 and len(set(roots.values())) == 1
    found = [plan.count("MapInArrow") for plan in plans]
    assert max(found) == 1 and sum(found) > 1


def test_small_tables_are_stored_in_few_files(spark, monkeypatch):
    files = []

    def noted(df, *args, write=components.pinned):
        stored = write(df, *args)
        files.append(len(stored.inputFiles()))
        return stored

    for module in (simhash, components):
        monkeypatch.setattr(module, "pinned", noted)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    links = spark.range(3_000).selectExpr("id * 2 a", "id * 2 + 1 + id % 2 b").repartition(5)
    try:
        nodes = components.components(links).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert nodes == len({n for i in range(3_000) for n in (2 * i, 2 * i + 1 + i % 2)})
    assert len(files) > 3 and max(files) <= 5
