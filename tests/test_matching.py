from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from listweave.operators import matching, spread
from listweave.operators.filters import keyword_filter
from listweave.operators.ranking import most_relevant, relevance

SCHEMA = "id int, title string, text string"


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(2)
    words = ["Data", "database", "é", "a", "an", "ant", "x-ray", "ray", "banana", "THE", "the"]

    def text():
        return " \n".join(dice.choice(words) for _ in range(dice.randrange(7)))

    listed = [(i, text(), text()) for i in range(120)] + [(120, None, "ant"), (121, "ant", None)]
    return spark.createDataFrame(listed, SCHEMA).repartition(3)


QUERIES = [
    (1, "data THE"), (2, "ant"), (3, "an  a\tTHE"), (4, "nowhere the"), (5, ""), (6, None),
    (7, "ray ray"), (8, "tab"), (9, "anan x-"), (10, "É"),
]


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 10])
def test_each_query_finds_what_it_finds_alone(spark, rows, monkeypatch, rows_per_salt):
    monkeypatch.setattr(spread.hot_keys, "__defaults__", (rows_per_salt,))
    queries = spark.createDataFrame(QUERIES, "q int, asked string")
    found = matching.all_terms_match(rows, "id", ["title", "text"], queries, "q", "asked")
    expected = set()
    for q, asked in QUERIES:
        if (asked or "").split():
            alone = keyword_filter(rows, F.lit(asked), F.col("title"), F.col("text"))
            expected |= {(q, r.id) for r in alone.collect()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 50


def test_each_query_ranks_as_alone(spark, rows):
    queries = spark.createDataFrame(QUERIES, "q int, asked string")
    found = matching.most_relevant_for(
        rows, "id", {"title": 2, "text": 1}, queries, "q", "asked", [F.col("key")], 5
    )
    filled = rows.fillna("").withColumn("all", F.lit(1))
    expected = set()
    for q, asked in QUERIES:
        terms = sorted(set((asked or "").lower().split()))
        if terms:
            score = relevance(terms, F.col("title"), F.col("text"))
            top = most_relevant(filled, ["all"], score, [F.col("id")], 5)
            expected |= {(q, r.id, r.score) for r in top.collect()}
    assert {tuple(r) for r in found.collect()} == expected


def test_no_query_is_held_against_all_rows(spark, rows):
    queries = spark.createDataFrame(QUERIES, "q int, asked string")
    found = matching.all_terms_match(rows, "id", ["title", "text"], queries, "q", "asked")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_rows_and_no_queries(spark, rows):
    queries = spark.createDataFrame(QUERIES, "q int, asked string")
    for some, asked in ((rows.limit(0), queries), (rows, queries.limit(0))):
        assert matching.all_terms_match(some, "id", ["title"], asked, "q", "asked").collect() == []


def test_short_terms_are_not_held_against_words(spark, monkeypatch):
    listed = [(1, "An \U0001f600é x", None), (2, "a n", "nA"), (3, "", "\U0001f600"), (None, "xé", "x")]
    rows = spark.createDataFrame(listed, SCHEMA)
    asked = ["an", "n", "\U0001f600é", "\U0001f600", "na", "xé", "é x", "a the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, asked string")
    held = []
    plain = matching.words_of_terms
    monkeypatch.setattr(
        matching, "words_of_terms",
        lambda words, terms: held.extend(r.term for r in terms.collect()) or plain(words, terms),
    )
    found = matching.all_terms_match(rows, "id", ["title", "text"], queries, "q", "asked")
    assert {tuple(r) for r in found.collect()} == {
        (0, 1), (1, 1), (1, 2), (2, 1), (3, 1), (3, 3), (4, 2), (5, None), (6, 1), (6, None),
    }
    assert held == ["the"]
