from __future__ import annotations

import random

import numpy as np
import pytest
from edge_rows import edge_documents, empty_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from listweave.llm import repeats, suffix_runs
from listweave.llm.suffix_runs import Entries


def brute(docs, length):
    first = {}
    for doc, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            if doc is not None:
                string = data[p : p + length]
                first[string] = min(first.get(string, doc), doc)
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if doc is not None and first[data[p : p + length]] < doc:
                gone[p : p + length] = [True] * length
        spans, kept = [], bytearray()
        for i, g in enumerate(gone):
            if not g:
                kept.append(data[i])
            elif spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(data), [tuple(s) for s in spans], bytes(kept)))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = repeats.without_repeats(docs, **options).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows),
        key=repr,
    )


def passages(seed):
    """Texts with shared passages, near copies, repeated stretches, and limits within characters."""
    dice = random.Random(seed)
    shared = [prose(1000 + i, 30) + " é☃ " * (i % 3) for i in range(6)]
    rows = []
    for i in range(60):
        text = prose(i if i % 5 else 5, dice.randrange(0, 60))
        for _ in range(dice.randrange(4)):
            passage = dice.choice(shared)
            a, b = sorted(dice.sample(range(len(passage)), 2))
            at = dice.randrange(len(text) + 1)
            text = text[:at] + passage[a:b] + text[at:]
        if i % 7 == 0 and rows:
            text = list(rows[dice.randrange(len(rows))][1] or "?")
            for _ in range(3):
                text[dice.randrange(len(text))] = dice.choice("xyzé")
            text = "".join(text)
        if i % 11 == 0:
            text += "ab" * dice.randrange(60)
        rows.append((dice.randrange(40), text))
    return rows + [(None, shared[0]), (None, shared[0]), (3, None), (4, "")]


@pytest.mark.parametrize("options", [
    {},
    {"block_bytes": 3000, "part_bytes": 700},
    {"block_bytes": 700, "part_bytes": 100_000, "length": 40},
])
def test_equals_brute_force(spark, options):
    rows = passages(len(options))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute(rows, options.get("length", 50))
    assert found(docs, **options) == expected
    assert any(len(spans) > 1 for _, _, spans, _ in expected)


def test_strings_at_limits_of_hashed_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACES_AT_ONCE", 97)
    rows = passages(8)
    data = "".join(t or "" for _, t in rows).encode()
    sizes = np.array([len((t or "").encode()) for _, t in rows], np.int64)
    block = repeats.Block(0, np.arange(len(rows)), sizes > 0, sizes, np.frombuffer(data, np.uint8))
    anchors = repeats.anchors_of(block, 50)
    owned = sorted(
        p for s, c in zip(anchors.start, anchors.count, strict=True) for p in range(s, s + c)
    )
    ends = np.cumsum(sizes)
    assert owned == [
        p for e, n in zip(ends, sizes, strict=True) for p in range(e - n, e - 49)
    ]  # each string within a document is owned once


def test_edge_rows(spark):
    docs = edge_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id != 7]
    short = docs.filter("doc_id IS NULL OR doc_id <> 7")
    assert found(short) == brute(rows, 50)
    assert found(empty_documents(spark)) == []
    long = {r[0]: r for r in found(docs)}
    assert long[7][1] == long[7][1] and long[12][2] == []  # repeats within one document stay


def test_a_passage_in_a_third_of_the_documents(spark):
    passage = prose(77, 40)
    rows = [(i, f"{prose(i, 12)} {passage if i % 3 == 0 else ''} {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(docs, block_bytes=2000, part_bytes=2000) == brute(rows, 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6), max_size=20), min_size=1, max_size=9))
def test_merge_gives_order_and_shared_prefixes(runs):
    runs = [sorted(bytes(b % 3 for b in s) for s in run) for run in runs]
    shared = [
        [0, *(next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(r, r[1:]))][: len(r)]
        for r in runs
    ]
    of_run, place, share = suffix_runs.merge_order(runs, shared, 6)
    merged = [runs[r][p] for r, p in zip(of_run, place)]
    assert merged == sorted(s for run in runs for s in run)
    for before, now, n in zip(merged, merged[1:], share[1:]):
        assert now[:n] == before[:n] and (n == 6 or now[n] != before[n])


def test_runs_come_back_from_their_code():
    dice = np.random.default_rng(4)
    n = 500
    columns = [dice.integers(0, 1 << 40, n) for _ in range(4)]
    entries = Entries(dice.integers(0, 3, (n, 12)).astype(np.uint8), *columns)
    run, shared, late = suffix_runs.sorted_run(entries)
    assert len(run) + len(late) == n
    back, strings, prefixes = suffix_runs.decoded(suffix_runs.coded(run, shared))
    assert strings == [bytes(s) for s in run.strings] and prefixes == shared.tolist()
    assert all((getattr(back, c) == getattr(run, c)).all() for c in ("doc", "block", "start", "count"))
