"""Schemas of landed payloads and of the records made from them.

JSON numbers that end up in text are declared as strings, which keeps the literal.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# The columns of the two stored records, in stored order.
JOB_COLUMNS = [
    "job_id",
    "source",
    "title",
    "job_type",
    "budget",
    "publish_time",
    "url",
    "description",
    "experience_level",
    "duration",
    "skills",
    "client_country",
    "client_payment_verified",
    "client_total_spent",
    "client_total_reviews",
    "client_total_feedback",
    "scraped_at",
]
BOARD_COLUMNS = [
    "job_id",
    "source",
    "title",
    "company",
    "location",
    "workplace_type",
    "employment_type",
    "experience_level",
    "description",
    "skills",
    "publish_time",
    "url",
    "applicant_count",
    "scraped_at",
]

# Source names, link base, page sizes.
JOB_SOURCE = "upwork"
BOARD_SOURCE = "linkedin"
JOB_LINK_BASE = "https://www.upwork.com/jobs/"
API_PAGE_SIZE = 50
CARD_PAGE_SIZE = 25

JOB_LISTING = _strings(JOB_COLUMNS)
BOARD_LISTING = _strings(BOARD_COLUMNS)

# Columns of landed pages and details, and field names of their payloads.
RAW_PAGES = (
    "source string, query string, query_pos int, origin string, page_no int, "
    "payload string, fetched_at timestamp"
)
RAW_DETAILS = "source string, job_id string, payload string, fetched_at timestamp"

STATE_JOB = (
    "struct<uid: string, ciphertext: string, title: string, description: string, "
    "publishedOn: string, createdOn: string, type: string, "
    "hourlyBudget: struct<min: string, max: string>, amount: struct<amount: string>, "
    "durationLabel: string, tierText: string, "
    "attrs: array<struct<prettyName: string, highlighted: boolean>>, "
    "client: struct<location: struct<country: string>, isPaymentVerified: boolean, "
    "totalSpent: struct<amount: string>, totalFeedback: double, totalReviews: string>>"
)
STATE_PAYLOAD = f"array<{STATE_JOB}>"
STATE_KEYS_PAYLOAD = (
    "array<struct<uid: string, ciphertext: string, publishedOn: string, createdOn: string>>"
)


def _api_envelope(element: str) -> str:
    return (
        "struct<data: struct<search: struct<universalSearchNuxt: struct<visitorJobSearchV1: "
        f"struct<results: array<{element}>>>>>>"
    )


API_JOB = (
    "struct<id: string, title: string, description: string, "
    "jobTile: struct<job: struct<ciphertext: string, jobType: string, hourlyBudgetMin: string, "
    "hourlyBudgetMax: string, fixedPriceAmount: struct<amount: string>, publishTime: string, "
    "contractorTier: string>>>"
)
API_PAYLOAD = _api_envelope(API_JOB)
API_KEYS_PAYLOAD = _api_envelope(
    "struct<id: string, jobTile: struct<job: struct<ciphertext: string, publishTime: string>>>"
)
API_RESULTS = "data.search.universalSearchNuxt.visitorJobSearchV1.results"

# Fields of cards and details.
CARD = _strings(["job_id", "title", "company", "location", "publish_time", "url"])
DETAIL = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("criteria", T.MapType(T.StringType(), T.StringType())),
        T.StructField("applicant_count", T.StringType()),
        T.StructField("workplace_badge", T.StringType()),
    ]
)
LINK = _strings(["href", "label"])
HEADINGS = _strings(["title", "headline"])
