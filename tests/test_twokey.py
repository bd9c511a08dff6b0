from __future__ import annotations

import random

import pytest

from listweave.operators import twokey
from listweave.operators.components import component_of
from listweave.operators.twokey import greedy_two_key

SCHEMA = "q string, a string, b string, i int"


def brute(rows):
    kept = set()
    for query in {r[0] for r in rows}:
        seen = set()
        for _, a, b, i in sorted((r for r in rows if r[0] == query), key=lambda r: r[3]):
            if a in seen or b in seen:
                continue
            seen.add(a)
            if b:
                seen.add(b)
            kept.add((query, i))
    return kept


def kept(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {(r.q, r.i) for r in greedy_two_key(df, ["q"], "a", "b", ["i"], **options).collect()}


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_dropped_item_takes_nothing(spark, rounds):
    rows = [("q", "A", "x", 1), ("q", "B", "x", 2), ("q", "C", "B", 3)]
    assert kept(spark, rows, rounds=rounds) == {("q", 1), ("q", 3)}


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_empty_keys(spark, rounds):
    rows = [
        ("q", "x", "", 1),  # looks up the empty key without taking it
        ("q", "", "", 2),
        ("q", "", "", 3),
        ("q", "y", "", 4),  # the empty key is taken by now
        ("q", "x", "z", 5),
        ("q", "w", "z", 6),
    ]
    assert brute(rows) == {("q", 1), ("q", 2), ("q", 6)}
    assert kept(spark, rows, rounds=rounds) == brute(rows)


def test_long_chain_in_rounds(spark):
    rows = [("q", str(i), str(i + 1), i) for i in range(8)]
    for options in ({"rounds": 9}, {"rounds": 1, "slice_rows": 2}):
        assert kept(spark, rows, **options) == {("q", i) for i in range(0, 8, 2)}


def test_chain_of_thousands_takes_few_turns(spark, monkeypatch):
    rows = [("q", str(i), str(i + 1), i) for i in range(5000)] + [
        ("hot", "same", str(i), i) for i in range(3000)
    ]
    written = []
    plain = twokey.pinned
    monkeypatch.setattr(twokey, "pinned", lambda df: written.append(1) or plain(df))
    assert kept(spark, rows) == {("q", i) for i in range(0, 5000, 2)} | {("hot", 0)}
    assert len(written) <= 12


def test_ties_and_null_groups(spark):
    rows = [("q", "A", "x", 1), ("q", "B", "y", 1), ("q", "B", "x", 1), ("q", "C", "z", None)]
    rows += [(None, "A", "x", 1), (None, "B", "y", 2), (None, "C", "x", 3)]
    for rounds in (0, 3):
        df = spark.createDataFrame(rows, SCHEMA)
        got = greedy_two_key(df, ["q"], "a", "b", ["i"], rounds=rounds).collect()
        # Nulls arrive first; of the tied items A-x comes before B-x.
        assert sorted((r.q or "", r.a, r.b) for r in got) == [
            ("", "A", "x"), ("", "B", "y"), ("q", "A", "x"), ("q", "B", "y"), ("q", "C", "z"),
        ]


def test_equal_items_count_once(spark):
    df = spark.createDataFrame([("q", "A", "x", 1)] * 3, SCHEMA)
    assert greedy_two_key(df, ["q"], "a", "b", ["i"]).count() == 1


@pytest.mark.parametrize("options", [
    {"rounds": 50},
    {"rounds": 50, "rows_per_salt": 20},
    {"rounds": 1, "slice_rows": 7, "rows_per_salt": 20},
    {"rounds": 0},
    {"rounds": 0, "slice_rows": 25},
    {"rounds": 1, "slice_rows": 40},
    {"rounds": 1, "unique_arrival": True},
])
def test_random_items_agree_with_a_loop(spark, options):
    dice = random.Random(3)
    rows = [("star", "hot", str(i), i) for i in range(120)]
    rows += [("same", "hot", "hot", i) for i in range(120)]
    for query, names in (("x", 30), ("y", 60)):
        for i in range(90):
            a, b = str(dice.randrange(names)), str(dice.randrange(names))
            rows.append((query, "" if a == "0" else a, "" if a == "0" or b == "0" else b, i))
    assert kept(spark, rows, **options) == brute(rows)


def test_small_components_take_one_turn(spark, monkeypatch):
    chains = [("q", f"{c}-{i}", f"{c}-{i + 1}", 20 * c + i) for c in range(40) for i in range(20)]
    giant = [("q", f"g{i}", f"g{i + 1}", 5000 + i) for i in range(90)]
    turns = []
    plain = twokey._in_order
    monkeypatch.setattr(twokey, "_in_order", lambda *a: turns.append(1) or plain(*a))
    assert kept(spark, chains, rounds=1, slice_rows=60) == brute(chains)
    assert len(turns) == 1
    # Only the component of more than 60 items needs further turns.
    assert kept(spark, chains + giant, rounds=0, slice_rows=60) == brute(chains + giant)
    assert len(turns) == 1 + 1 + 2


def test_no_items(spark):
    assert kept(spark, []) == set()


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(200)]
    links += [(1000, 1000 + i) for i in range(1, 150)]
    links += [(2000 + i, 2000 + (i + 7) % 30) for i in range(30)] + [(3000, 3000)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    found = {r.node: r.root for r in component_of(df).collect()}
    expected = dict.fromkeys(range(201), 0) | dict.fromkeys(range(1000, 1150), 1000)
    assert found == expected | dict.fromkeys(range(2000, 2030), 2000)
    assert component_of(df.limit(0)).collect() == []


def test_rounds_go_on_while_they_settle_much(spark, monkeypatch):
    dice = random.Random(5)
    rows = [("q", str(dice.randrange(400)), str(400 + dice.randrange(400)), i) for i in range(4000)]
    monkeypatch.setattr(twokey, "_by_components", lambda *args: pytest.fail("components"))
    assert kept(spark, rows, slice_rows=40) == brute(rows)


def test_rounds_end_when_they_settle_little(spark, monkeypatch):
    rounds = []
    plain = twokey._taken
    monkeypatch.setattr(twokey, "_taken", lambda *args: rounds.append(1) or plain(*args))
    rows = [("q", str(i), str(i + 1), i) for i in range(60)]
    assert kept(spark, rows, slice_rows=20) == {("q", i) for i in range(0, 60, 2)}
    assert len(rounds) == 1
