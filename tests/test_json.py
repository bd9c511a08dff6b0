from __future__ import annotations

import json

from pyspark.sql import functions as F

from listweave.plans import normalise
from listweave.schemas import JOB_COLUMNS
from listweave.sources import json_pages

STAMP = "2026-03-30T10:00:00+00:00"


def envelope(results):
    return {"data": {"search": {"universalSearchNuxt": {"visitorJobSearchV1": {"results": results}}}}}


def pages(spark, *payloads):
    texts = [p if isinstance(p, str) or p is None else json.dumps(p) for p in payloads]
    return spark.createDataFrame(list(enumerate(texts)), "page_no int, payload string")


def state_records(spark, *jobs):
    found = json_pages.state_jobs(pages(spark, list(jobs)))
    records = normalise.state_listings(found, F.lit(STAMP)).orderBy("pos").collect()
    return [r.asDict() for r in records]


def api_records(spark, *jobs):
    found = json_pages.api_jobs(pages(spark, envelope(list(jobs))))
    records = normalise.api_listings(found, F.lit(STAMP)).orderBy("pos").collect()
    return [r.asDict() for r in records]


def test_broken_pages_give_no_jobs(spark):
    state = json_pages.state_jobs(pages(spark, "[{", "null", None, "", [], [{"uid": "1"}]))
    assert [(r.page_no, r.pos, r.job.uid) for r in state.collect()] == [(5, 0, "1")]
    api = pages(
        spark, "{", {}, {"data": None}, {"data": {"search": {}}}, envelope(None), envelope([]),
        envelope([{"id": "1"}, {"id": "2"}]), "[]",
    )
    assert sorted((r.page_no, r.pos, r.job.id) for r in json_pages.api_jobs(api).collect()) == [
        (6, 0, "1"), (6, 1, "2"),
    ]


def test_state_job_with_everything(spark):
    job = {
        "uid": "10", "ciphertext": "~0210", "title": "Model builder", "description": "\n do it \t",
        "publishedOn": "2026-03-30T08:00:00Z", "createdOn": "2026-03-29T08:00:00Z", "type": 1,
        "hourlyBudget": {"min": 20, "max": 45.5}, "amount": {"amount": 0},
        "durationLabel": "1 to 3 months", "tierText": "Expert",
        "attrs": [{"prettyName": n, "highlighted": False} for n in ["a", "", "b", "c", "d", "e"]],
        "client": {
            "location": {"country": "Chile"}, "isPaymentVerified": True,
            "totalSpent": {"amount": 5000.0}, "totalFeedback": 4.9, "totalReviews": 12,
        },
    }
    (got,) = state_records(spark, job)
    assert got.pop("page_no") == 0 and got.pop("pos") == 0
    assert got == {
        "job_id": "10", "source": "upwork", "title": "Model builder", "job_type": "HOURLY",
        "budget": "$20-$45.5/hr", "publish_time": "2026-03-30T08:00:00Z",
        "url": "https://www.upwork.com/jobs/~0210", "description": "do it",
        "experience_level": "Expert", "duration": "1 to 3 months", "skills": "a, b, c, d",
        "client_country": "Chile", "client_payment_verified": "Yes", "client_total_spent": "$5K+",
        "client_total_reviews": "12", "client_total_feedback": "4.90", "scraped_at": STAMP,
    }
    assert list(got) == JOB_COLUMNS


def test_state_job_with_nothing(spark):
    (got,) = state_records(spark, {})
    filled = {k: v for k, v in got.items() if v not in ("", "N/A", 0)}
    assert filled == {"source": "upwork", "scraped_at": STAMP}
    assert [k for k, v in got.items() if v == "N/A"] == [
        "title", "job_type", "budget", "publish_time", "url", "experience_level", "duration",
    ]


def test_state_job_nulls_and_fallbacks(spark):
    got = state_records(
        spark,
        {"uid": "", "ciphertext": "~01", "publishedOn": "", "createdOn": "2026-01-01", "type": 2,
         "amount": {"amount": 300.0}, "client": {"location": None, "isPaymentVerified": False,
         "totalSpent": None, "totalFeedback": None, "totalReviews": None}},
        {"uid": 77, "amount": None, "client": {"location": {"country": None}, "totalFeedback": "5",
         "totalReviews": 0, "totalSpent": {"amount": 0}}},
    )
    first, second = got
    assert (first["job_id"], first["publish_time"], first["budget"]) == ("~01", "2026-01-01", "$300.0")
    assert (first["client_payment_verified"], first["client_total_reviews"]) == ("No", "")
    assert (second["job_id"], second["budget"], second["client_country"]) == ("77", "N/A", "")
    assert (second["client_total_feedback"], second["client_total_reviews"]) == ("", "0")
    assert second["client_total_spent"] == ""


def test_api_job(spark):
    def job(**inner):
        return {"id": "1", "title": "T", "description": " d ", "jobTile": {"job": inner}}

    hourly, fixed, no_amount, bare, no_inner = api_records(
        spark,
        job(ciphertext="~021", jobType="HOURLY", hourlyBudgetMin=25.0, hourlyBudgetMax=50.0,
            publishTime="2026-03-30T08:00:00+00:00", contractorTier="IntermediateLevel"),
        job(ciphertext="", jobType="FIXED", fixedPriceAmount={"amount": 300.0}),
        job(jobType="FIXED", fixedPriceAmount=None),
        {"id": None, "jobTile": None},
        {"id": "", "jobTile": {"job": None}},
    )
    assert hourly["budget"] == "$25.0-$50.0/hr" and hourly["experience_level"] == "Intermediate"
    assert hourly["url"].endswith("/~021") and hourly["description"] == "d"
    assert (fixed["budget"], fixed["url"], fixed["publish_time"]) == ("$300.0", "N/A", "N/A")
    assert no_amount["budget"] == "N/A"
    assert (bare["job_id"], bare["job_type"], bare["title"], bare["budget"]) == ("", "N/A", "N/A", "N/A")
    assert no_inner["job_id"] == ""
    for record in (hourly, bare):
        assert record["duration"] == "N/A"
        assert {v for k, v in record.items() if k.startswith("client_") or k == "skills"} == {""}


def test_api_key_falls_back_to_the_cipher(spark):
    (got,) = api_records(spark, {"id": "", "jobTile": {"job": {"ciphertext": "~02z"}}})
    assert got["job_id"] == "~02z"


def test_dispatch_by_origin(spark):
    rows = [
        ("state", json.dumps({"uid": "1", "durationLabel": "long"})),
        ("api", json.dumps({"id": "2"})),
        (None, json.dumps({"id": "3"})),
    ]
    df = spark.createDataFrame(rows, "origin string, job_json string")
    got = normalise.job_listings(df, F.lit(STAMP)).orderBy("job_id").collect()
    assert [(r.job_id, r.duration) for r in got] == [("1", "long"), ("2", "N/A"), ("3", "N/A")]


def test_typed_companions(spark):
    found = json_pages.state_jobs(pages(spark, [{
        "uid": "1", "type": 1, "hourlyBudget": {"min": 5, "max": 9.5}, "createdOn": "2026-03-30",
        "attrs": [{"prettyName": "a"}, {"prettyName": "b"}],
        "client": {"isPaymentVerified": False, "totalReviews": 3, "totalFeedback": 4.5,
                   "totalSpent": {"amount": 1234.5}},
    }])).withColumn("total_spent", normalise.spent_amount(F.col("job")))
    got = normalise.with_typed_job_columns(normalise.state_listings(found)).first()
    assert str(got.total_spent) == "1234.50" and got.client_total_spent == "$1K+"
    assert (str(got.budget_min), str(got.budget_max)) == ("5.00", "9.50")
    assert got.skills_arr == ["a", "b"] and got.payment_verified is False
    assert (got.total_reviews, got.total_feedback, str(got.publish_ts)[:10]) == (3, 4.5, "2026-03-30")
    assert got.scraped_ts is not None
