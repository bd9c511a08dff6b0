"""Whole runs: cases worked out by hand, and runs at random against the rule."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listweave.plans import board_run
from listweave.plans.board_run import collect_cards
from listweave.plans.job_run import collect_jobs
from listweave.sources.registry import source

NOW = datetime(2026, 3, 30, 12)
SCHEMA = "query string, query_pos int, origin string, page_no int, payload string"


def stamp(days_ago):
    return (NOW - timedelta(days=days_ago)).isoformat()


def state(uid="", cipher="", days_ago=0.0):
    return {"uid": uid, "ciphertext": cipher, "publishedOn": stamp(days_ago)}


def api(key="", cipher="", days_ago=0.0, text=None):
    when = text if text is not None else stamp(days_ago)
    return {"id": key, "jobTile": {"job": {"ciphertext": cipher, "publishTime": when}}}


def landed(spark, runs):
    """``runs``: query -> (state jobs, list of API pages)."""
    rows = []
    for place, (query, (first, others)) in enumerate(runs.items()):
        if first is not None:
            rows.append((query, place, "state", 0, json.dumps(first)))
        for number, page in enumerate(others):
            nested = page
            for level in ("results", "visitorJobSearchV1", "universalSearchNuxt", "search", "data"):
                nested = {level: nested}
            rows.append((query, place, "api", number, json.dumps(nested)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids(spark, runs, count=100, days=None, page_size=3, **options):
    got = collect_jobs(landed(spark, runs), count, days, NOW, page_size, **options).collect()
    found = {query: [] for query in runs}
    for row in sorted(got, key=lambda r: r["rank"]):
        found[row.query].append(row.job_id)
    return found


def places(first, others, days, page_size):
    """Key, keys taken and age of every job that is looked at, in order of arrival."""
    short = [n for n, page in enumerate(others) if len(page) < page_size]
    read = others[: short[0] + 1] if short else others
    found = []
    for job in first or []:
        key = job["uid"] or job["ciphertext"]
        found += [(key, {key}, job["publishedOn"])] if key else []
    for job in (job for page in read for job in page):
        cipher = job["jobTile"]["job"]["ciphertext"]
        key = job["id"] or cipher
        keys = {key, cipher.lstrip("~0") if cipher else key}
        found.append((key, keys, job["jobTile"]["job"]["publishTime"]))

    def old(when):
        limit = None if days is None else (NOW - timedelta(days=days)).isoformat()
        return limit is not None and when < limit

    return [(key, keys, old(when)) for key, keys, when in found]


def explained(got, run, count, days, page_size):
    """Whether the kept keys are what the rule says, place by place: a job stays if none of its
    keys was taken before it and no job that would have stayed was old by then."""
    items = places(*run, days, page_size)
    taken, at, stopped = set(), [], False
    for place, (_, keys, old) in enumerate(items):
        free = not keys & taken
        stopped = stopped or (free and old)
        if free and not stopped:
            at.append(place)
            # An empty second key is looked up, but taken only by a job without any key.
            taken |= keys if keys == {""} else keys - {""}
    return got == [items[place][0] for place in at][:count]


CASES = {
    "duplicate in a page": (None, [[api("A"), api("B"), api("A")]]),
    "duplicate across pages": (None, [[api("A"), api("B"), api("C")], [api("B"), api("D")]]),
    "cutoff drops later pages": (None, [[api("A"), api("B"), api("C", days_ago=9)], [api("D")]]),
    "new old new": (None, [[api("A"), api("B", days_ago=9), api("C")]]),
    "old duplicate": (None, [[api("A"), api("A", days_ago=9), api("B")]]),
    "state before api": ([state("S")], [[api("A"), api("S")]]),
    "state cutoff ends all": ([state("S"), state("O", days_ago=9), state("T")], [[api("A")]]),
    "state without a key": ([state(), state("", "~c"), state("T")], [[api("A")]]),
    "short page in the middle": (None, [[api("A"), api("B"), api("C")], [api("D")], [api("E")]]),
    "empty page": (None, [[api("A"), api("B"), api("C")], [], [api("E")]]),
    "no api page": ([state("S")], []),
    "bad time": (None, [[api("A", text="not-a-date"), api("B", text=""), api("C", days_ago=9)]]),
    "greedy chain": (None, [[api("A", "x"), api("B", "x"), api("C", "B")]]),
    "prefixed cipher": ([state("2abc")], [[api("q", "~02abc"), api("r", "~02r")]]),
    "empty api key": (None, [[api(), api(), api("A")]]),
    "cipher of zeros": (None, [[api("A", "~0"), api(), api("B", "~00")]]),
}


EXPECTED = {
    "duplicate in a page": ["A", "B"],
    "duplicate across pages": ["A", "B", "C", "D"],
    "cutoff drops later pages": ["A", "B"],
    "new old new": ["A"],
    "old duplicate": ["A", "B"],
    "state before api": ["S", "A"],
    "state cutoff ends all": ["S"],
    "state without a key": ["~c", "T", "A"],
    "short page in the middle": ["A", "B", "C", "D"],
    "empty page": ["A", "B", "C"],
    "no api page": ["S"],
    "bad time": ["A", "B"],
    "greedy chain": ["A", "C"],
    "prefixed cipher": ["2abc", "r"],
    "empty api key": ["", "A"],
    "cipher of zeros": ["A", ""],
}


def test_named_cases(spark):
    assert ids(spark, CASES, days=2) == EXPECTED


def twice(spark, pages, again):
    """``pages`` landed, and ``again`` landed some time later."""
    first = landed(spark, pages).withColumn("fetched_at", F.lit(NOW))
    later = landed(spark, again).withColumn("fetched_at", F.lit(NOW + timedelta(hours=1)))
    return first.unionByName(later)


def records(raw, page_size=50):
    got = collect_jobs(raw, 100, None, NOW, page_size).collect()
    return [(r["rank"], r.job_id) for r in sorted(got, key=lambda r: (r.query, r["rank"]))]


def test_page_that_landed_twice_counts_once(spark):
    page = {"q": (None, [[api("A"), api("B")]])}
    raw = landed(spark, page)
    assert records(raw.unionByName(raw)) == [(1, "A"), (2, "B")]
    assert records(twice(spark, page, page)) == [(1, "A"), (2, "B")]


def test_pages_of_two_fetches(spark):
    first, second = [api("A"), api("B")], [api("C"), api("A")]
    raw = twice(spark, {"q": (None, [first])}, {"q": (None, [second])})
    assert records(raw) == [(1, "A"), (2, "B"), (3, "C")]
    # Each fetch ends at its own short page.
    full = [api("D"), api("E"), api("F")]
    raw = twice(spark, {"q": (None, [first, [api("X")]])}, {"q": (None, [full, [api("Y")]])})
    assert [key for _, key in records(raw, page_size=3)] == ["A", "B", "D", "E", "F", "Y"]


def test_page_without_a_query_is_an_error(spark):
    raw = landed(spark, {"q": (None, [[api("A")]])}).withColumn("query", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="has no query"):
        records(raw)


def test_payloads_are_parsed_below_the_generator(spark):
    raw = landed(spark, {"q": ([state("S")], [[api("A")]])})
    plan = collect_jobs(raw, 10, None, NOW)._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.splitlines() if "Project" in line and "from_json" in line]
    assert not above and plan.count("from_json") == 2
    assert all("from_json" in line for line in plan.splitlines() if "Generate inline" in line)


@pytest.mark.parametrize("count, days", [(5, None), (1500, 3), (None, 0)])
def test_random_runs(spark, count, days):
    dice = random.Random(11)
    runs = {}
    for number in range(6):
        def job(make):
            cipher = dice.choice(["", "~0", f"~02{dice.randrange(30)}", str(dice.randrange(30))])
            age = -1 if dice.random() < 0.9 else 5
            return make(dice.choice(["", str(dice.randrange(60))]), cipher, age)

        others = [[job(api) for _ in range(4)] for _ in range(dice.randrange(8))]
        if others:
            others[-1] = others[-1][: dice.randrange(5)]
        runs[f"q{number}"] = ([job(state) for _ in range(6)], others)
    got = ids(spark, runs, count, days, page_size=4)
    for query, run in runs.items():
        assert explained(got[query], run, count, days, 4), query


def test_strip_version_matches_the_plain_key(spark):
    runs = {"q": ([state("abc")], [[api("zzz", "~02abc")]])}
    assert ids(spark, runs) == {"q": ["abc", "zzz"]}
    assert ids(spark, runs, strip_version=True) == {"q": ["abc"]}


def test_records_carry_their_origin_fields(spark):
    first = [{**state("S", "~02S"), "durationLabel": "long"}]
    got = collect_jobs(landed(spark, {"q": (first, [[api("A", "~02A")]])}), 10, None, NOW).collect()
    assert sorted((r.job_id, r.duration, r["rank"]) for r in got) == [("A", "N/A", 2), ("S", "long", 1)]


def card(key, day):
    return (
        f'<li><div data-entity-urn="urn:x:{key}"><h3 class="base-search-card__title">T{key}</h3>'
        f'<time datetime="{day}"></time></div></li>'
    )


def test_board_run(spark):
    pages = [
        ("q", 0, 0, card("1", "2026-03-30") + card("2", "") + card("1", "2020-01-01")),
        ("q", 0, 1, card("3", "2026-03-29") + card("4", "bad") + card("5", "2026-03-27")),
        ("q", 0, 2, card("6", "2026-03-30") * 3),
        ("r", 1, 0, card("7", "2026-03-30") + card("1", "2026-03-30")),
        ("r", 1, 1, card("8", "2026-03-30") * 3),
    ]
    raw = spark.createDataFrame(pages, "query string, query_pos int, page_no int, payload string")
    details = spark.createDataFrame(
        [
            ("1", '<div class="show-more-less-html__markup">old</div>', datetime(2026, 3, 1)),
            ("1", '<div class="show-more-less-html__markup">text</div>', datetime(2026, 3, 2)),
            ("9", "<p>", datetime(2026, 3, 2)),
            ("3", "", datetime(2026, 3, 2)),
        ],
        "job_id string, payload string, fetched_at timestamp",
    )
    for count in (100, 5000):
        got = collect_cards(raw, count, 1, NOW, details, page_size=3).collect()
        assert sorted((r.query, r["rank"], r.job_id, r.description) for r in got) == [
            ("q", 1, "1", "text"), ("q", 2, "2", ""), ("q", 3, "3", ""), ("q", 4, "4", ""),
            ("r", 1, "7", ""), ("r", 2, "1", "text"),
        ]
    without = collect_cards(raw, 2, 1, NOW, page_size=3).collect()
    assert sorted((r.query, r.job_id, r.workplace_type) for r in without) == [
        ("q", "1", ""), ("q", "2", ""), ("r", "1", ""), ("r", "7", ""),
    ]


def test_board_pages_of_two_fetches(spark):
    schema = "query string, query_pos int, page_no int, payload string, fetched_at timestamp"
    first, second = card("1", "") + card("2", ""), card("3", "") + card("1", "")
    late = NOW + timedelta(hours=1)
    raw = spark.createDataFrame(
        [("q", 0, 0, first, NOW), ("q", 0, 0, first, NOW), ("q", 0, 0, second, late)], schema
    )
    got = collect_cards(raw, 100, 1, NOW).collect()
    assert sorted((r["rank"], r.job_id) for r in got) == [(1, "1"), (2, "2"), (3, "3")]


def test_a_page_that_landed_again_is_parsed_once(spark, monkeypatch):
    schema = "query string, query_pos int, page_no int, payload string, fetched_at timestamp"
    first, late = card("1", "") + card("2", ""), NOW + timedelta(hours=1)
    rows = [("q", 0, 0, first, NOW)] * 3 + [("q", 0, 0, card("3", ""), late)]
    parsed = []
    plain = board_run.card_pages
    monkeypatch.setattr(
        board_run, "card_pages", lambda pages, **size: parsed.append(pages.count()) or plain(pages, **size)
    )
    got = collect_cards(spark.createDataFrame(rows, schema), 100, 1, NOW).collect()
    assert sorted(r.job_id for r in got) == ["1", "2", "3"]
    assert parsed == [2]


def test_sources_by_name():
    assert source("upwork") is collect_jobs and source("linkedin") is collect_cards
    with pytest.raises(KeyError):
        source("unknown")
