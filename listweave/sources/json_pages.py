"""Jobs out of landed JSON pages. Broken payloads yield no jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.schemas import API_PAYLOAD, API_RESULTS, STATE_PAYLOAD


def state_array(payload: Column, schema: str = STATE_PAYLOAD) -> Column:
    return F.from_json(payload, schema)


def api_array(payload: Column, schema: str = API_PAYLOAD) -> Column:
    found = F.from_json(payload, schema)
    for level in API_RESULTS.split("."):
        found = found[level]
    return found


def exploded(pages: DataFrame, jobs: Column) -> DataFrame:
    """One row per job with its position on the page."""
    kept = [c for c in pages.columns if c != "payload"]
    return pages.select(*kept, F.posexplode(jobs).alias("pos", "job"))


def state_jobs(pages: DataFrame) -> DataFrame:
    """Page-state payload: an array of jobs."""
    return exploded(pages, state_array(F.col("payload")))


def api_jobs(pages: DataFrame) -> DataFrame:
    """API payload: jobs within an envelope."""
    return exploded(pages, api_array(F.col("payload")))
