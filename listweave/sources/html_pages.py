"""Cards and details out of landed HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.functions.html import detail_fields, search_cards
from listweave.functions.text import excerpt, without_query
from listweave.operators.enrich import workplace_type


#: Markup that one task parses, about a second of work.
PARSE_BYTES = 4 << 20


def balanced(pages: DataFrame, size: int | None) -> DataFrame:
    """Pages in as many parts as their ``size`` in bytes asks for. Parsing takes a thousand times as
    long as moving, and parts that were made before the payloads existed say nothing of it."""
    return pages.repartition(max(1, -(-(size or 0) // PARSE_BYTES)))


def payload_bytes(pages: DataFrame) -> int:
    return pages.agg(F.sum(F.octet_length("payload"))).first()[0] or 0


def card_pages(raw_pages: DataFrame, size: int | None = None) -> DataFrame:
    """Pages with their ``cards`` in place of the payload. ``size`` is that of all payloads, if it is
    known."""
    spread = balanced(raw_pages, payload_bytes(raw_pages) if size is None else size)
    return spread.withColumn("cards", search_cards("payload")).drop("payload")


def card_items(pages: DataFrame) -> DataFrame:
    """One row per card with its position on the page."""
    kept = [c for c in pages.columns if c != "cards"]
    cards = pages.select(*kept, F.posexplode("cards").alias("pos", "card"))
    return cards.select(*kept, "pos", "card.*").withColumn("url", without_query(F.col("url")))


def parsed_details(details: DataFrame, key: str = "job_id", size: int | None = None) -> DataFrame:
    """Supplementary fields of each detail payload; an empty payload leaves them blank. ``size`` is
    that of all payloads, if it is known."""
    spread = balanced(details, payload_bytes(details) if size is None else size)
    parsed = spread.select(key, detail_fields("payload").alias("detail")).select(key, "detail.*")
    criteria = F.col("criteria")

    def criterion(name: str):
        return F.coalesce(F.element_at(criteria, name), F.lit(""))

    # Criteria headers.
    return parsed.select(
        key,
        excerpt(F.col("description")).alias("description"),
        criterion("seniority level").alias("experience_level"),
        criterion("employment type").alias("employment_type"),
        criterion("job function").alias("skills"),
        "applicant_count",
        workplace_type(F.col("workplace_badge"), criteria).alias("workplace_type"),
    )
