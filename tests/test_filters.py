from __future__ import annotations

import json
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from listweave.operators import enrich, filters, ranking
from listweave.operators.filters import Facets
from listweave.sources import manifest


def test_facets_from_lists_and_text():
    got = Facets.of({"location": "Oslo", "experience_levels": " 2, 4,", "employment_types": ["F"]})
    assert got == Facets("Oslo", ["2", "4"], ["F"], [], "")
    assert Facets.of({}) == Facets() and Facets.of({"workplace_types": None}) == Facets()
    with pytest.raises(ValueError, match="9"):
        Facets.of({"workplace_types": ["1", "9"]})


def test_window_and_precedence():
    assert [Facets().window(d) for d in (None, 0, 1, 2, 7, 8)] == [
        "", "r86400", "r86400", "r604800", "r604800", "r2592000",
    ]
    assert Facets(time_filter="r86400").window(30) == "r86400"
    assert Facets(time_filter="r86400").window(None) == "r86400"


def test_parameters_in_order():
    facets = Facets("United States", ["2", "4"], ["F", "C"], ["2"])
    assert list(facets.parameters(3).items()) == [
        ("location", "United States"), ("f_E", "2,4"), ("f_JT", "F,C"), ("f_WT", "2"), ("f_TPR", "r604800"),
    ]
    assert Facets().parameters() == {}


def test_overrides():
    settings = {"location": "Oslo", "workplace_types": ["2", "3"], "experience_levels": ["1"]}
    merged = filters.with_overrides(
        settings, "Rome", workplace="remote", employment_type="contract", experience_level="director"
    )
    assert merged == {
        "location": "Rome", "workplace_types": ["2", "3"], "experience_levels": ["5"],
        "employment_types": ["C"],
    }
    assert filters.with_overrides(settings, workplace="onsite")["workplace_types"] == ["1"]
    assert filters.with_overrides(settings) == settings
    assert settings["location"] == "Oslo" and "employment_types" not in settings


def test_keep_is_or_within_and_between(spark):
    rows = [("Oslo", "2", "F", "1"), ("Oslo", "4", "F", "2"), ("Oslo", "5", "F", "1"), ("Rome", "2", "F", "1")]
    df = spark.createDataFrame(
        rows, "location string, experience_code string, employment_code string, workplace_code string"
    )
    kept = Facets("Oslo", ["2", "4"], ["F", "P"]).keep(df)
    assert {r.experience_code for r in kept.collect()} == {"2", "4"} and kept.count() == 2
    assert Facets().keep(df).count() == 4


def test_unknown_codes_can_fail_the_job(spark):
    df = spark.createDataFrame([("a, x",)], "codes string")
    known = spark.createDataFrame([("a",), ("b",)], "code string")
    parsed = filters.parsed_facets(df, "codes", known, "code")
    assert [(r.code, r.is_known) for r in parsed.orderBy("code_pos").collect()] == [("a", True), ("x", False)]
    assert filters.reject_unknown(parsed.filter("is_known")).count() == 1
    with pytest.raises(Exception, match="unknown facet code: x"):
        filters.reject_unknown(parsed).collect()


def test_code_lookup_keeps_unlisted(spark):
    codes = spark.createDataFrame([(v, k) for k, v in filters.EXPERIENCE_CODES.items()], "code string, word string")
    df = spark.createDataFrame([("2", 1), ("9", 2)], "code string, i int")
    got = filters.labelled(df, codes, "code").collect()
    assert sorted((r.code, r.word) for r in got) == [("2", "entry"), ("9", None)]


def test_last_value_of_a_repeated_header(spark):
    rows = [("d", "Seniority", "low", 1), ("d", "seniority", "high", 2), ("d", "other", "x", 0)]
    df = spark.createDataFrame(rows, "doc string, header string, value string, pos int")
    got = enrich.last_values(df, ["doc"], F.lower("header"), F.col("value"), F.col("pos")).first()
    assert got["values"] == {"seniority": "high", "other": "x"}


def test_card_requests_equal_url_encoding(spark):
    names = ["machine learning", "c++ & c#", "a*b~c-d_e.f", "é/?=", ""]
    queries = spark.createDataFrame([(n,) for n in names], "query string")
    facets = Facets("United States", ["2", "4"], [], ["2"])
    got = manifest.card_requests(queries, 3, facets, days=1).collect()
    assert len(got) == 15
    for row in got:
        expected = {"keywords": row["query"], "start": str(row.start), "sortBy": "DD",
                    **facets.parameters(1)}
        assert row.parameters == urlencode(expected)
    assert {r.start for r in got} == {0, 25, 50}


def test_api_requests(spark):
    queries = spark.createDataFrame([('say "hi"',)], "query string")
    got = sorted(manifest.api_requests(queries, 2).collect(), key=lambda r: r.start)
    assert [json.loads(r.variables) for r in got] == [
        {"requestVariables": {"userQuery": 'say "hi"', "sort": "recency",
                              "paging": {"offset": start, "count": 50}}}
        for start in (0, 50)
    ]


def test_budget_and_words(spark):
    rows = [("1", "$20-$50/hr", "Web dev"), ("2", "$300", "web DEV job"), ("3", "N/A", "dev"),
            ("4", "$300", "design"), ("5", "$300", None)]
    df = spark.createDataFrame(rows, "job_id string, budget string, title string")
    got = ranking.budget_at_least(df, F.col("budget"), 50, ["DEV j", "zzz"], F.col("title"))
    assert sorted(r.job_id for r in got.collect()) == ["1", "4", "5"]


def test_relevance(spark):
    rows = [("q", "1", "rust rust", "go"), ("q", "2", "go", "rust"), ("q", "3", "c", "c"), ("q", "4", "go", "RUST")]
    df = spark.createDataFrame(rows, "query string, job_id string, title string, text string")
    score = ranking.relevance(["Rust", "go"], F.col("title"), F.col("text"))
    got = ranking.most_relevant(df, ["query"], score, [F.col("job_id")], 2)
    assert sorted((r.job_id, r.score) for r in got.collect()) == [("1", 3), ("2", 3)]
