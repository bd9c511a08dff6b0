from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from edge_rows import edge_documents, empty_documents
from pyspark.sql import functions as F

from listweave.llm import hard_negatives as hn
from listweave.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, keep):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag, sum(bag.values())) for doc, bag in bags if bag]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in terms(text)
                if bag[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:keep], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=repr)


def searched(docs, items, **options):
    rows = rs.ranked(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, rows), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    dice = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ΑΒ", "x9"]

    def text(n):
        return " ".join(words[min(int(dice.expovariate(0.08)), 62)] for _ in range(n))

    docs = [(i, text(dice.randrange(0, 50))) for i in range(400)]
    docs += [(400 + i % 3, docs[i % 5][1]) for i in range(40)]
    items = [(i, text(dice.randrange(0, 9))) for i in range(25)] + [(3, "W1 w1 nowhere"), (None, "w2")]
    monkeypatch.setattr(rs, "TREE_ROWS", 256)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for options in ({"keep": 20}, {"keep": 3, "item_bytes": 120}):
        assert searched(table, bench, **options) == brute_search(docs, items, options["keep"])


def test_search_leaves_branches_out():
    """Once good documents are known, a tree without better ones is left at its root."""
    import pyarrow as pa

    n = 500
    ranks = np.tile([0, 1], n)
    tree = rs.grown(pa.array(range(n)), np.full(n, 100), np.full(n, 2), ranks, np.ones(2 * n, np.int64))
    ranking = rs.Ranking(2)
    ranking.add(np.array([10**9, 10**9]), [7, 8])
    seen = []
    plain, rs.weighed = rs.weighed, lambda *a: seen.append(len(a[1])) or plain(*a)
    try:
        rs.search(tree, np.array([0, 1]), np.array([5, 5]), ranking)
    finally:
        rs.weighed = plain
    assert seen == [1] and [i for _, _, i in ranking.best] == [7, 8]


def test_search_on_edge_rows(spark):
    docs = edge_documents(spark)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "quick1 brown2 One"), (2, None), (2, ""), (None, "naïve 日本語"), (5, "x" * 5000)]
    bench = spark.createDataFrame([(*x, "r", 1) for x in items], "item_id int, text string, _row string, rank int")
    assert searched(docs, bench) == brute_search(plain, items, 20)
    assert searched(empty_documents(spark), bench) == []
    assert searched(docs, bench.limit(0)) == []


def brute_negatives(rows):
    """Rows as (place, id, label, vector); None where the contract leaves a row out."""
    used = [
        (place, i, label, [math.floor(256 * x) for x in vector])
        for place, i, label, vector in rows
        if i is not None
        and label is not None
        and vector is not None
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out = []
    for place, anchor, label, vector in used:
        if anchor % 100:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, other)), i, own, kind)
            for own, i, kind, other in used
            if own != place
        )
        positives = [s for s in scored if s[3] == label][:5]
        for minus, positive, _, _ in positives:
            score = -minus
            band = [s for s in scored if s[3] != label and 30 * score <= -100 * s[0] <= 90 * score]
            for rank, (low, negative, _, _) in enumerate(band[:10], 1):
                out.append((anchor, positive, rank, negative, score, -low))
    return sorted(out)


def mined(df, label=None, **options):
    label = F.col("label") if label is None else label
    rows = hn.hard_negatives(df, label, F.col("vec_id") % 100 == 0, **options).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in rows)


SCHEMA = "vec_id bigint, embedding array<float>, label int, _row string, q string, n int"


def vectors(spark, rows):
    table = [(i, vector, label, "r", "q", 1) for _, i, label, vector in rows]
    return spark.createDataFrame(table, SCHEMA)


@pytest.mark.parametrize("dims, wave", [(64, 2048), (13, 3), (3, 1)])
def test_negatives_equal_brute_force(spark, dims, wave):
    dice = np.random.default_rng(dims)
    # Few different values, so that there are ties.
    values = (dice.integers(-3, 4, (600, dims)) / 8).astype(np.float32)
    rows = [(i, i, int(dice.integers(0, 3)), values[i].tolist()) for i in range(600)]
    expected = brute_negatives(rows)
    assert len(expected) > 100
    df = vectors(spark, rows).repartition(3)
    assert mined(df, wave_anchors=wave) == expected


def test_negatives_on_edge_rows(spark):
    good = [0.5, -0.25, 1.0]
    rows = [
        (0, 0, 1, good),
        (1, 100, 1, [0.5, 0.5, 0.5]),
        (2, 1, 1, good),
        (3, 1, 1, good),
        (4, 2, 2, [0.25, 0.0, 0.5]),
        (5, 3, 2, [0.25, 0.0, 0.5]),
        (6, 4, None, good),
        (7, 5, 2, None),
        (8, 6, 2, [0.5, None, 1.0]),
        (9, 7, 2, [0.5, float("nan"), 1.0]),
        (10, 8, 2, [0.5, float("inf"), 1.0]),
        (11, None, 2, good),
        (12, 9, 2, []),
        (13, 10, 2, [0.9]),
        (14, 200, 3, []),
    ]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, rows).limit(0)) == []
    assert mined(vectors(spark, rows).filter("vec_id = 1")) == []
    huge = [*rows, (15, 11, 2, [1e30, 0.0, 0.0])]
    assert mined(vectors(spark, huge)) == brute_negatives(rows)


def test_a_repeated_anchor_gives_its_rows_twice(spark):
    rows = [(0, 0, 1, [1.0, 1.0]), (1, 0, 1, [1.0, 1.0]), (2, 3, 2, [0.5, 0.5]), (3, 4, 2, [0.5, 0.25])]
    found = mined(vectors(spark, rows))
    assert len(found) == 4 and {f[:2] for f in found} == {(0, 0)}


@pytest.mark.parametrize("dims, peak", [(1, 1), (8, 200), (20, 40_000), (64, (1 << 25) - 1)])
def test_table_lookups_are_inner_products(dims, peak):
    dice = np.random.default_rng(peak)
    anchors = dice.integers(-peak, peak + 1, (5, dims))
    rows = dice.integers(-peak, peak + 1, (30, dims))
    rows[0], rows[1] = -peak, peak
    bits = peak.bit_length() + 1
    table = hn.subset_sums(anchors, hn.sum_type(dims, bits))
    assert (hn.scores(table, hn.plane_bytes(rows, bits)) == rows @ anchors.T).all()
