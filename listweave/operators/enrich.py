"""Details of the listings that were kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.operators.spread import group_join, stored_join
from listweave.session import pinned


def last_values(
    df: DataFrame, group: list[str], key: Column, value: Column, order: Column
) -> DataFrame:
    """One map per group; of several values for a key the last in order stays."""
    last = (
        df.groupBy(*group, key.alias("_key"))
        .agg(F.max_by(value, order).alias("_value"))
        .groupBy(*group)
        .agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("values"))
    )
    return last


def workplace_type(badge: Column, criteria: Column) -> Column:
    """The badge, even an empty one, else the criterion for it."""
    return F.coalesce(badge, F.element_at(criteria, "on-site/remote"), F.lit(""))


def with_blanks(rows: DataFrame, details: DataFrame, on: str) -> DataFrame:
    """Left join of at most one detail row per key; missing text becomes empty."""
    added = [c for c in details.columns if c != on]
    spread = [c for c in rows.columns if c != on]
    details = details.filter(F.col(on).isNotNull())
    return group_join(rows, details, [on], "left", spread).fillna("", subset=added)


def latest_details(
    raw_details: DataFrame, kept: DataFrame, key: str = "job_id"
) -> tuple[DataFrame, int]:
    """Latest payload of each kept listing, and the size of them all; no other payload is parsed.

    Which one it is, is decided on key, time and digest. Only details of wanted keys are moved, and
    of those that are not the latest no payload. A payload that landed again from one time comes
    once for each landing, as telling equal ones apart would take a shuffle of the payloads; what is
    read from them is equal, too.
    """
    wanted = kept.select(key).distinct()
    place = F.struct("fetched_at", "_digest", "_bytes")
    marked = raw_details.withColumn("_digest", F.xxhash64("payload"))
    narrow = group_join(
        marked.select(key, "fetched_at", "_digest", F.octet_length("payload").alias("_bytes")),
        wanted,
        [key],
        "left_semi",
        ["_digest"],
    )
    latest = pinned(
        narrow.groupBy(key)
        .agg(F.max(place).alias("_last"))
        .select(
            key, F.col("_last.fetched_at").alias("fetched_at"), "_last._digest", "_last._bytes"
        )
    )
    chosen = stored_join(
        marked.select(key, "fetched_at", "_digest", "payload"),
        latest.drop("_bytes"),
        [key, "fetched_at", "_digest"],
        "left_semi",
        ["_digest"],
    )
    return chosen.select(key, "payload"), latest.agg(F.sum("_bytes")).first()[0] or 0
