"""Flat records out of parsed jobs, one projection per payload shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.functions import money, text
from listweave.functions.times import ingest_stamp, iso_date, iso_timestamp
from listweave.schemas import (
    API_JOB,
    BOARD_COLUMNS,
    BOARD_SOURCE,
    JOB_COLUMNS,
    JOB_SOURCE,
    STATE_JOB,
)

API_ORIGIN = "api"
STATE_ORIGIN = "state"


def state_key(job: Column) -> Column:
    return text.first_filled(job["uid"], job["ciphertext"], default="")


def api_key(job: Column) -> Column:
    return text.first_filled(job["id"], job["jobTile"]["job"]["ciphertext"], default="")


def state_publish_time(job: Column) -> Column:
    return text.first_filled(job["publishedOn"], job["createdOn"])


def spent_amount(job: Column) -> Column:
    """What the client of a page-state job has spent, before it becomes a band."""
    return job["client"]["totalSpent"]["amount"].try_cast(money.AMOUNT)


def _projected(
    df: DataFrame, fields: dict[str, Column], order: list[str], stamp: Column | None
) -> DataFrame:
    fields["scraped_at"] = ingest_stamp() if stamp is None else stamp
    kept = [c for c in df.columns if c not in ("job", *order)]
    return df.select(*kept, *[fields[name].alias(name) for name in order])


def state_listings(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Records of page-state jobs in column ``job``."""
    job = F.col("job")
    client = job["client"]
    kind = text.job_type(job["type"])
    fields = {
        "job_id": state_key(job),
        "source": F.lit(JOB_SOURCE),
        "title": F.coalesce(job["title"], F.lit(text.MISSING)),
        "job_type": kind,
        "budget": money.state_budget(
            kind, job["hourlyBudget"]["min"], job["hourlyBudget"]["max"], job["amount"]["amount"]
        ),
        "publish_time": F.coalesce(state_publish_time(job), F.lit(text.MISSING)),
        "url": text.job_url(job["ciphertext"]),
        "description": text.excerpt(job["description"]),
        "experience_level": text.experience_level(job["tierText"]),
        "duration": text.first_filled(job["durationLabel"], default=text.MISSING),
        "skills": text.top_skills(job["attrs"]["prettyName"]),
        "client_country": F.coalesce(client["location"]["country"], F.lit("")),
        "client_payment_verified": text.yes_no(client["isPaymentVerified"]),
        "client_total_spent": money.spend_band(client["totalSpent"]["amount"]),
        "client_total_reviews": money.whole_number(client["totalReviews"]),
        "client_total_feedback": money.two_decimals(client["totalFeedback"]),
    }
    return _projected(df, fields, JOB_COLUMNS, stamp)


def api_listings(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Records of API jobs in column ``job``; the API tells nothing about clients."""
    job = F.col("job")
    inner = job["jobTile"]["job"]
    kind = F.coalesce(inner["jobType"], F.lit(text.MISSING))
    fields = {
        "job_id": api_key(job),
        "source": F.lit(JOB_SOURCE),
        "title": F.coalesce(job["title"], F.lit(text.MISSING)),
        "job_type": kind,
        "budget": money.api_budget(
            kind,
            inner["hourlyBudgetMin"],
            inner["hourlyBudgetMax"],
            inner["fixedPriceAmount"]["amount"],
        ),
        "publish_time": F.coalesce(inner["publishTime"], F.lit(text.MISSING)),
        "url": text.job_url(inner["ciphertext"]),
        "description": text.excerpt(job["description"]),
        "experience_level": text.experience_level(inner["contractorTier"]),
        "duration": F.lit(text.MISSING),
    }
    fields |= {name: F.lit("") for name in JOB_COLUMNS if name not in fields}
    return _projected(df, fields, JOB_COLUMNS, stamp)


def job_listings(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Records of jobs in text column ``job_json``, by ``origin``; no origin means API."""
    is_state = F.coalesce(F.col("origin") == STATE_ORIGIN, F.lit(False))

    def parsed(schema: str) -> DataFrame:
        return df.withColumn("job", F.from_json("job_json", schema)).drop("job_json")

    state = state_listings(parsed(STATE_JOB).filter(is_state), stamp)
    return state.unionByName(api_listings(parsed(API_JOB).filter(~is_state), stamp))


def board_listings(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Records of cards with or without details; a missing field is empty."""
    fields = {
        name: F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
        for name in BOARD_COLUMNS
    }
    fields["source"] = F.lit(BOARD_SOURCE)
    return _projected(df, fields, BOARD_COLUMNS, stamp)


def with_typed_job_columns(listings: DataFrame) -> DataFrame:
    """Typed companions of the text columns of a job record. The exact amount spent is not in the
    record; take :func:`spent_amount` along as a column of its own."""
    lowest, highest = money.budget_bounds(F.col("budget"))
    verified = F.col("client_payment_verified")
    return listings.select(
        "*",
        lowest.alias("budget_min"),
        highest.alias("budget_max"),
        iso_timestamp(F.col("publish_time")).alias("publish_ts"),
        F.filter(F.split("skills", ", "), lambda s: s != "").alias("skills_arr"),
        F.when(verified == "Yes", True).when(verified == "No", False).alias("payment_verified"),
        F.col("client_total_reviews").try_cast("bigint").alias("total_reviews"),
        F.col("client_total_feedback").try_cast("double").alias("total_feedback"),
        iso_timestamp(F.col("scraped_at")).alias("scraped_ts"),
    )


def with_typed_board_columns(listings: DataFrame) -> DataFrame:
    """Typed companions of the text columns of a board record."""
    count = F.regexp_extract(F.regexp_replace("applicant_count", r"(\d),(\d)", "$1$2"), r"\d+", 0)
    return listings.select(
        "*",
        iso_date(F.col("publish_time")).alias("publish_date"),
        count.try_cast("int").alias("applicants"),
        iso_timestamp(F.col("scraped_at")).alias("scraped_ts"),
    )
