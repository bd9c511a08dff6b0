"""Run over landed HTML: cards of search pages, then details of the cards that stay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.functions.times import older_than_date
from listweave.operators.arrival import collected, consumed_pages, fetches, first_seen
from listweave.operators.enrich import latest_details, with_blanks
from listweave.operators.spread import stored_join
from listweave.plans.normalise import board_listings
from listweave.schemas import BOARD_SOURCE, CARD_PAGE_SIZE
from listweave.session import pinned, use_utc
from listweave.sources.html_pages import card_items, card_pages, parsed_details
from listweave.sources.registry import register

ARRIVAL = ["fetch_no", "page_no", "pos"]


@register(BOARD_SOURCE)
def collect_cards(
    raw_pages: DataFrame,
    count: int | None,
    days: int | None,
    as_of: datetime,
    raw_details: DataFrame | None = None,
    page_size: int = CARD_PAGE_SIZE,
    stamp: Column | None = None,
) -> DataFrame:
    """Records of a run with ``query``, ``query_pos`` and ``rank``."""
    use_utc(raw_pages.sparkSession)
    when = F.col("fetched_at") if "fetched_at" in raw_pages.columns else F.lit(None)
    landed = raw_pages.select(
        F.coalesce("query", F.raise_error(F.lit("a landed page has no query"))).alias("query"),
        "query_pos",
        "page_no",
        when.cast("timestamp").alias("fetched_at"),
        F.xxhash64("payload").alias("digest"),
        F.octet_length("payload").alias("bytes"),
        "payload",
    )
    landed = pinned(landed.withColumn("landing", F.monotonically_increasing_id()))
    # What landed again is told by narrow columns, so each page of a fetch is parsed once. The short
    # result of the Python step is pinned.
    pages = fetches(
        landed.drop("payload"), ["query", "page_no"], ["query_pos", "digest", "landing"]
    )
    numbers = pinned(pages.select("landing", "fetch_no", "bytes"))
    size = numbers.agg(F.sum("bytes")).first()[0] or 0
    once = stored_join(
        landed.drop("fetched_at", "bytes"), numbers.drop("bytes"), ["landing"], "inner", ["digest"]
    )
    parsed = pinned(card_pages(once.drop("digest"), size=size))
    # Which pages count is decided without their cards.
    narrow = parsed.select("*", F.size("cards").alias("n_items")).drop("cards")
    consumed = consumed_pages(narrow, ["query", "fetch_no"], "page_no", "n_items", page_size)
    counted = pinned(consumed.select("landing"))
    cards = card_items(parsed.join(counted, "landing", "left_semi").drop("landing"))
    unique = first_seen(cards, ["query", "job_id"], ARRIVAL)
    dated = unique.withColumn("old", older_than_date(F.col("publish_time"), as_of, days))
    kept = collected(dated, ["query"], "old", ARRIVAL, count).drop("old", *ARRIVAL)
    if raw_details is not None:
        kept = pinned(kept)
        latest, size = latest_details(raw_details, kept)
        details = parsed_details(latest, size=size).dropDuplicates(["job_id"])
        kept = with_blanks(kept, details, "job_id")
    return board_listings(kept, stamp)
