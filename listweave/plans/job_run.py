"""Run over landed JSON pages.

A first pass reads only the fields that decide which jobs stay and shuffles nothing wider. The
payloads of the pages that hold survivors are parsed in full afterwards.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.functions import text
from listweave.functions.times import older_than_time
from listweave.operators.arrival import collected, consumed_pages, fetches
from listweave.operators.spread import stored_join
from listweave.operators.twokey import greedy_two_key
from listweave.plans.normalise import (
    STATE_ORIGIN,
    api_key,
    api_listings,
    state_key,
    state_listings,
    state_publish_time,
)
from listweave.schemas import (
    API_KEYS_PAYLOAD,
    API_PAGE_SIZE,
    JOB_SOURCE,
    STATE_KEYS_PAYLOAD,
    STATE_PAYLOAD,
)
from listweave.session import pinned, use_utc
from listweave.sources.json_pages import api_array, state_array
from listweave.sources.registry import register

PAGE = ["query", "origin_rank", "page_no"]
#: What tells one landing of a page from another.
LANDING = [*PAGE, "query_pos", "fetched_at", "digest"]
# Bits of the parts of an arrival number: how often fetched, origin, page, position on the page.
FETCH_BITS, PAGE_BITS, POS_BITS = 15, 24, 23


def _is_state() -> Column:
    return F.coalesce(F.col("origin") == STATE_ORIGIN, F.lit(False))


def _is_state_rank() -> Column:
    return F.col("origin_rank") == 0


def ranked_pages(raw_pages: DataFrame) -> DataFrame:
    """Pages with ``origin_rank``, as page-state pages come before the API pages of the same query,
    and ``digest`` of the payload. A page without a query is an error."""
    if "fetched_at" not in raw_pages.columns:
        raw_pages = raw_pages.withColumn("fetched_at", F.lit(None).cast("timestamp"))
    return raw_pages.withColumns(
        {
            "query": F.coalesce("query", F.raise_error(F.lit("a landed page has no query"))),
            "origin_rank": F.when(_is_state(), 0).otherwise(1),
            "digest": F.xxhash64("payload"),
        }
    )


def ends_fetch(page_size: int = API_PAGE_SIZE) -> Column:
    """Whether a landed API page is short and so the last one of its fetch."""
    jobs = F.size(api_array(F.col("payload"), API_KEYS_PAYLOAD))
    return ~_is_state() & (F.greatest(jobs, F.lit(0)) < page_size)


def is_exempt() -> Column:
    """Page-state pages come before all API pages of their fetch and end nothing."""
    return _is_state()


def arrival_number() -> Column:
    """Fetch, origin, page and position in one number."""
    parts = [("fetch_no", FETCH_BITS), ("origin_rank", 1), ("page_no", PAGE_BITS), ("pos", POS_BITS)]
    number, fits = F.lit(0).cast("bigint"), F.lit(True)
    for name, bits in parts:
        value = F.col(name).cast("bigint")
        number = F.shiftleft(number, bits) + value
        fits = fits & value.between(0, (1 << bits) - 1)
    problem = F.raise_error(F.lit("fetch, page or position is out of range"))
    return F.when(fits, number).otherwise(problem.cast("bigint"))


def job_items(pages: DataFrame, strip_version: bool = False) -> DataFrame:
    """Keys and publish time of every job on the pages. API jobs may have an empty key."""
    state = state_array(F.col("payload"), STATE_KEYS_PAYLOAD)
    api = api_array(F.col("payload"), API_KEYS_PAYLOAD)

    def state_item(job: Column) -> Column:
        key = state_key(job)
        return F.struct(
            key.alias("key"), key.alias("other_key"), state_publish_time(job).alias("published")
        )

    def api_item(job: Column) -> Column:
        key = api_key(job)
        cipher = text.filled(job["jobTile"]["job"]["ciphertext"])
        return F.struct(
            key.alias("key"),
            F.coalesce(text.stripped_cipher(cipher, strip_version), key).alias("other_key"),
            text.filled(job["jobTile"]["job"]["publishTime"]).alias("published"),
        )

    found = F.when(_is_state(), F.transform(state, state_item)).otherwise(
        F.transform(api, api_item)
    )
    return pages.select(*LANDING, F.coalesce(found, F.array()).alias("items"))


def surviving_jobs(
    pages: DataFrame,
    count: int | None,
    days: int | None,
    as_of: datetime,
    page_size: int = API_PAGE_SIZE,
) -> DataFrame:
    """Place of every job that stays, out of stored ``pages`` of :func:`job_items`: landing of the
    page, position on it and rank in its query. Later fetches of a query come after earlier ones,
    and each ends at its own short page."""
    fetched = fetches(pages, PAGE, ["query_pos", "digest"])
    consumed = consumed_pages(
        fetched.withColumn("n_items", F.size("items")),
        ["query", "fetch_no"],
        "page_no",
        "n_items",
        page_size,
        exempt=F.col("origin_rank") == 0,
    )
    items = consumed.select(*LANDING, "fetch_no", F.posexplode("items").alias("pos", "item"))
    placed = items.select(*LANDING, "pos", arrival_number().alias("at"), "item.*")
    keyed = placed.filter((F.col("origin_rank") == 1) | (F.col("key") != ""))
    kept = greedy_two_key(keyed, ["query"], "key", "other_key", ["at"], unique_arrival=True)
    dated = kept.withColumn("old", older_than_time(F.col("published"), as_of, days))
    return collected(dated, ["query"], "old", ["at"], count).select(*LANDING, "pos", "rank")


@register(JOB_SOURCE)
def collect_jobs(
    raw_pages: DataFrame,
    count: int | None,
    days: int | None,
    as_of: datetime,
    page_size: int = API_PAGE_SIZE,
    strip_version: bool = False,
    stamp: Column | None = None,
) -> DataFrame:
    """Records of a run with ``query``, ``query_pos`` and ``rank``."""
    use_utc(raw_pages.sparkSession)
    ranked = ranked_pages(raw_pages)
    pages = pinned(job_items(ranked, strip_version))
    repeated = not pages.groupBy(*LANDING).count().filter("count > 1").isEmpty()
    survivors = surviving_jobs(pages, count, days, as_of, page_size)
    entries = F.collect_list(F.struct("pos", "rank"))
    places = pinned(
        survivors.groupBy(*LANDING).agg(F.map_from_entries(entries).alias("places"))
    )

    def jobs(of_origin: Column, array: Column) -> DataFrame:
        landed = ranked.filter(of_origin).select(*LANDING, "payload")
        held = stored_join(landed, places, LANDING, "inner", ["digest"])
        # The array is read as the argument of the function, once a page, not once a job.
        ranks = F.transform(
            array,
            lambda job, pos: F.struct(
                F.try_element_at("places", pos).alias("rank"), job.alias("job")
            ),
        )
        kept = F.filter(ranks, lambda job: job["rank"].isNotNull())
        found = held.select("query", "query_pos", F.inline(kept))
        # Of a page that landed again only the jobs that stay go through a shuffle.
        return found.dropDuplicates(["query", "rank"]) if repeated else found

    payload = F.col("payload")
    state = state_listings(jobs(_is_state_rank(), state_array(payload, STATE_PAYLOAD)), stamp)
    return state.unionByName(api_listings(jobs(~_is_state_rank(), api_array(payload)), stamp))
