from __future__ import annotations

import numpy as np

from listweave.llm import embeddings


def brute(rows, cosine=0.9):
    units, links, top = {}, {}, {}
    for n, (_, v) in enumerate(rows):
        top[n] = n
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float64) / np.abs(v).max()
            units[n] = v / np.linalg.norm(v)
    for a in units:
        links[a] = [
            b
            for b in units
            if b != a and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine
        ]

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, others in links.items():
        for b in others:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            r = root(n)
            least[r] = min(least.get(r, i), i)
    return [(i, len(links.get(n, ())), least.get(root(n))) for n, (i, _) in enumerate(rows)]


def clusters(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for size in (150, 40, 7, 2, 2, 1, 1):
        center = rng.standard_normal(32)
        rows += [(len(rows) + i, center + rng.standard_normal(32) * 0.15) for i in range(size)]
    rows += [(1000 + i, rng.standard_normal(32)) for i in range(300)]
    rows += [(2000 + i, rows[3][1]) for i in range(200)]
    return [(i, np.asarray(v, np.float32).tolist()) for i, v in rows]


SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, vector int, pass int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, "n", 1, 2) for i, v in rows], SCHEMA)
    got = embeddings.embedding_groups(df, **kw).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((tuple(r)[:3] for r in got), key=repr)


def test_groups_equal_brute_force(spark):
    rows = clusters()
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_tiles_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE_ROWS", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rows = clusters(1)
    assert run(spark, rows, window=32) == sorted(brute(rows), key=repr)


def test_recall_at_the_threshold(spark):
    """Pairs of just over 0.9 among many vectors, the worst case for the passes."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(48)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(48)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.91 * a + np.sqrt(1 - 0.91**2) * b).tolist())]
    got = run(spark, rows)
    found = sum(n for _, n, _ in got)
    total = sum(n for _, n, _ in brute(rows))
    assert total >= 2900 and found >= 0.95 * total


def units(rows):
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def cone_rows(n, pairs, dims=64, inner=0.8, cosine=0.905):
    """A third of the rows in a cone with pairwise cosine ``inner``; row i of it, up to ``pairs``,
    has a partner at ``cosine``, which is row ``n // 3 + i``."""
    rng = np.random.default_rng(3)
    axis = units(rng.standard_normal(dims))

    def across(count, *away):
        rows = rng.standard_normal((count, dims))
        for x in (axis, *away):
            rows -= (rows * x).sum(1, keepdims=True) * x
        return units(rows)

    own = across(n // 3)
    share = (cosine - inner) / (1 - inner)
    other = share * own[:pairs] + np.sqrt(1 - share**2) * across(pairs, own[:pairs])
    cone = np.sqrt(inner) * axis + np.sqrt(1 - inner) * np.concatenate([own, other])
    return np.concatenate([cone, units(rng.standard_normal((n - len(cone), dims)))])


def test_recall_in_a_hot_cone(spark):
    """Signs hardly tell the rows of a cone apart, so windows hold a small part of it."""
    n, pairs = 20_000, 400
    rows = [(i, v) for i, v in enumerate(cone_rows(n, pairs).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["component_id"] for r in embeddings.embedding_groups(df).collect()}
    met = sum(got[i] == got[n // 3 + i] for i in range(pairs))
    assert len(got) == n and met >= 0.95 * pairs


def test_ranges_are_halved_by_medians():
    rows = cone_rows(8_192, 0)
    planes = embeddings.planes_of(0, 64)
    keys = embeddings.projection_keys(rows, 0, cuts=embeddings.medians_of(rows, planes))
    sizes = np.bincount(keys >> (embeddings.BITS - 6), minlength=64)
    assert sizes.min() >= 127 and sizes.max() <= 129


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []),
        (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]),
        (None, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 5.0]), (11, [-1.0, 0.0, 0.0]),
        (12, [3e38, 0.0, 0.0]), (12, [3e38, 0.0, 0.0]), (0, [0.0, -0.0, 0.0]), (13, [0.0, 1.0, 0.0]),
        (14, [-0.0, 1.0, 0.0]),
    ]
    expected = brute(rows)
    got = run(spark, rows)
    assert got == sorted(expected, key=repr)
    assert (1, 4, 1) in got and (3, 0, 3) in got and (13, 1, 13) in got
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
