"""What is new in a run, and the run's counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.operators.arrival import first_seen


def _own_if_empty(key: str, spread: list[str]) -> Column:
    """The key, or something unique for an empty one: those are never duplicates of each other
    and must not meet in one task."""
    unique = F.concat_ws("\u0001", F.lit("\u0001"), *[F.col(c).cast("string") for c in spread])
    return F.coalesce(F.nullif(F.col(key), F.lit("")), unique)


def first_writer(listings: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Each key only for the first query that returned it. ``arrival`` is unique in the run."""
    probed = listings.withColumn("_probe", _own_if_empty(key, arrival))
    return first_seen(probed, ["_probe"], arrival).drop("_probe")


def unseen(listings: DataFrame, ids: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Listings whose key is not among ``ids``."""
    stored = ids.select(F.col(key).alias("_probe"))
    return (
        listings.withColumn("_probe", _own_if_empty(key, arrival))
        .join(stored, "_probe", "left_anti")
        .drop("_probe")
    )


def query_counts(fetched: DataFrame, new: DataFrame, query: str = "query") -> DataFrame:
    """Fetched, new and skipped per query."""
    fetched_rows = fetched.groupBy(query).agg(F.count("*").alias("fetched"))
    new_rows = new.groupBy(query).agg(F.count("*").alias("new"))
    return fetched_rows.join(new_rows, query, "left").select(
        query,
        "fetched",
        F.coalesce("new", F.lit(0)).cast("bigint").alias("new"),
        (F.col("fetched") - F.coalesce("new", F.lit(0))).cast("bigint").alias("skipped"),
    )


def run_totals(counts: DataFrame, query: str = "query", total: str = "(all)") -> DataFrame:
    """The counts with one more row for the whole run."""
    return counts.rollup(query).agg(
        F.grouping(query).alias("_all"),
        F.sum("fetched").alias("fetched"),
        F.sum("new").alias("new"),
        F.sum("skipped").alias("skipped"),
    ).select(
        F.when(F.col("_all") == 1, total).otherwise(F.col(query)).alias(query),
        "fetched",
        "new",
        "skipped",
    )
