from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from listweave.operators import arrival, spread
from listweave.operators.grouping import by_query, ordered_union

SCHEMA = "feed string, key string, at int, old boolean"


def items(spark, *rows):
    return spark.createDataFrame([("f", key, i, old) for i, (key, old) in enumerate(rows)], SCHEMA)


def keys(df):
    return [r.key for r in df.orderBy("rank").collect()]


def run(spark, rows, count):
    unique = arrival.first_seen(items(spark, *rows), ["feed", "key"], ["at"])
    return keys(arrival.collected(unique, ["feed"], "old", ["at"], count))


def new(*names):
    return [(n, False) for n in names]


@pytest.mark.parametrize("count", [10, 5000, None])
def test_cutoff_is_a_prefix(spark, count):
    assert run(spark, [*new("A", "B", "A"), ("C", True), *new("D")], count) == ["A", "B"]


@pytest.mark.parametrize("count", [10, 5000, None])
def test_old_duplicate_does_not_stop(spark, count):
    assert run(spark, [("A", False), ("A", True), ("B", False)], count) == ["A", "B"]


@pytest.mark.parametrize("count", [10, None])
def test_first_item_old_leaves_nothing(spark, count):
    assert run(spark, [("A", True), ("B", False)], count) == []


def test_cap(spark):
    assert run(spark, new("A", "B", "A", "C"), 2) == ["A", "B"]
    assert run(spark, new("A", "B"), 0) == []


def brute(rows, count):
    kept = {}
    for feed in {r[0] for r in rows}:
        seen, out = set(), []
        for _, key, at, old in sorted((r for r in rows if r[0] == feed), key=lambda r: r[2]):
            if key in seen:
                continue
            if old or (count is not None and len(out) >= count):
                break
            seen.add(key)
            out.append((at, len(out) + 1))
        kept[feed] = out
    return {(feed, *place) for feed, out in kept.items() for place in out}


def test_small_and_large_caps_agree_with_a_loop(spark, monkeypatch, many_partitions):
    dice = random.Random(7)
    rows = []
    for feed, n in (("hot", 900), ("mild", 200), ("tiny", 3)):
        rows += [(feed, str(dice.randrange(n)), at, dice.random() < 3 / n) for at in range(n)]
    dice.shuffle(rows)
    unique = arrival.first_seen(
        spark.createDataFrame(rows, SCHEMA).repartition(5), ["feed", "key"], ["at"]
    )
    for count, pruned in ((50, 1000), (50, 1), (None, 1000)):
        monkeypatch.setattr(arrival, "PRUNED_CAP", pruned)
        got = arrival.collected(unique, ["feed"], "old", ["at"], count).collect()
        assert {(r.feed, r["at"], r["rank"]) for r in got} == brute(rows, count)
        capped = arrival.capped(unique, ["feed"], ["at"], 5).collect()
        assert len(capped) == 5 + 5 + len({r[1] for r in rows if r[0] == "tiny"})


def test_null_group_is_a_group_for_every_cap(spark, monkeypatch, many_partitions):
    rows = [(None, str(i), i, i == 3) for i in range(1, 7)]
    rows += [("q", str(i), i, False) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for count, pruned in ((1000, 1000), (1001, 1000), (None, 1000), (50, 1), (50, 1000)):
        monkeypatch.setattr(arrival, "PRUNED_CAP", pruned)
        got = arrival.collected(df, ["feed"], "old", ["at"], count).collect()
        of_null = sorted((r["at"], r["rank"]) for r in got if r.feed is None)
        assert of_null == [(1, 1), (2, 2)]
        assert sum(r.feed == "q" for r in got) == min(400, count or 400)


def test_null_old_is_not_old_for_every_cap(spark):
    rows = [("a", None), ("b", False), ("c", None), ("d", True), ("e", None)]
    for count in (1000, 1001, None):
        assert run(spark, rows, count) == ["a", "b", "c"]


def test_large_null_group_is_numbered_once(spark, many_partitions):
    df = spark.createDataFrame([(None, i) for i in range(399)], "g string, i int").repartition(4)
    got = spread.numbered(df, ["g"], [F.col("i")], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 400))


def test_pages_of_a_null_query_end(spark):
    got = arrival.consumed_pages(pages(spark, [50, 30, 50], None), ["query"], "page", "n", 50)
    assert sorted(r.page for r in got.collect()) == [0, 1]


def test_first_seen_keeps_all_columns_of_the_first(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "k string, at int, v string")
    assert [tuple(r) for r in arrival.first_seen(rows, ["k"], ["at"]).collect()] == [("a", 1, "early")]


def test_first_seen_of_numbers_is_a_hash_aggregate(spark):
    rows = [("a", 2, 5.0, None), ("a", 1, 7.0, True), ("b", 3, None, False)]
    df = spark.createDataFrame(rows, "k string, at int, v double, flag boolean")
    first = arrival.first_seen(df, ["k"], ["at"])
    assert sorted(map(tuple, first.collect())) == [("a", 1, 7.0, True), ("b", 3, None, False)]
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()


def pages(spark, sizes, query="q"):
    return spark.createDataFrame(
        [(query, i, n) for i, n in enumerate(sizes)], "query string, page int, n int"
    )


@pytest.mark.parametrize(
    "sizes, consumed",
    [([50, 30, 50], [0, 1]), ([50, 50], [0, 1]), ([50, 0, 50], [0, 1]), ([10], [0]), ([0, 50], [0])],
)
def test_short_page_is_consumed_and_ends(spark, sizes, consumed):
    got = arrival.consumed_pages(pages(spark, sizes), ["query"], "page", "n", 50)
    assert sorted(r.page for r in got.collect()) == consumed


def test_exempt_page_ends_nothing(spark):
    got = arrival.consumed_pages(
        pages(spark, [3, 50, 20, 50]), ["query"], "page", "n", 50, exempt=F.col("page") == 0
    )
    assert sorted(r.page for r in got.collect()) == [0, 1, 2]


@pytest.fixture
def many_partitions(spark):
    """Small tables would be coalesced to one partition."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_running_total_of_one_hot_group(spark, many_partitions):
    rows = [("hot", i, i % 7) for i in range(3000)] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    expected, sums = set(), {}
    for g, i, v in rows:
        sums[g] = sums.get(g, 0) + v
        expected.add((g, i, sums[g]))
    ranged = spread.ranged(df, ["g"], [F.col("i")])
    assert ranged.filter("g = 'hot'").select("_part").distinct().count() > 1
    got = spread.running_total(df, ["g"], [F.col("i")], F.col("v"), "total").collect()
    assert {(r.g, r.i, r.total) for r in got} == expected


def test_numbered_descending(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "g string, i int")
    got = spread.numbered(df, ["g"], [F.col("i").desc()], "n").collect()
    assert {(r.i, r.n) for r in got} == {(i, 100 - i) for i in range(100)}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, how):
    rows = [("hot", i) for i in range(500)] + [("b", i) for i in range(20)] + [("none", 1)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = spark.createDataFrame([("hot", "x"), ("b", "y"), ("unused", "z")], "k string, v string")
    plain = df.join(table, "k", how)
    salted = spread.group_join(df, table, ["k"], how, ["i"], broadcast_bytes=-1, rows_per_salt=50)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_joins_of_null_keys_agree(spark, how):
    rows = [(None, i) for i in range(200)] + [("b", i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = spark.createDataFrame([(None, "x"), ("c", "y")], "k string, v string")
    wide, narrow = (
        spread.group_join(df, table, ["k"], how, ["i"], broadcast_bytes=size, rows_per_salt=50)
        for size in (-1, 1 << 20)
    )
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))
    assert wide.count() == {"left": 220, "inner": 200, "left_semi": 200, "left_anti": 20}[how]


def test_salted_join_splits_the_hot_key(spark, many_partitions):
    df = spark.createDataFrame([("hot", i) for i in range(500)], "k string, i int")
    hot = spread.hot_keys(df.groupBy("k").agg(F.count("*").alias("_n")), 50)
    assert [(r.k, r["_parts"]) for r in hot.collect()] == [("hot", 10)]
    table = spark.createDataFrame([("hot", "x")], "k string, v string")
    joined = spread.salted_join(df, table.hint("merge"), ["k"], "left", ["i"], hot)
    assert joined.select(F.spark_partition_id()).distinct().count() > 1


def test_by_query_keeps_every_listing_in_order(spark):
    rows = [("q2", 1, "a"), ("q2", 0, "b"), ("q1", 5, "c")]
    got = by_query(spark.createDataFrame(rows, "query string, at int, v string"), "query", ["at"])
    assert {(r.query, r.v, r.pos, r.n_items) for r in got.collect()} == {
        ("q2", "b", 1, 2), ("q2", "a", 2, 2), ("q1", "c", 1, 1),
    }


def test_by_query_with_ties_and_nulls(spark):
    rows = [("q", 1, "a"), ("q", 1, "b"), ("q", None, "c"), (None, 2, "d"), (None, None, "e")]
    got = by_query(spark.createDataFrame(rows, "query string, at int, v string"), "query", ["at"])
    found = {r.v: (r.query, r.pos, r.n_items) for r in got.collect()}
    assert {found.pop("a"), found.pop("b")} == {("q", 1, 3), ("q", 2, 3)}
    assert found == {"c": ("q", 3, 3), "d": (None, 1, 2), "e": (None, 2, 2)}


def test_ordered_union(spark):
    a, b = spark.range(1), spark.range(2)
    assert sorted((r.branch, r.id) for r in ordered_union([a, b]).collect()) == [(0, 0), (1, 0), (1, 1)]
