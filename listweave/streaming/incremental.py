"""Repeated runs that take up only what has landed since, and never write a key twice."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from listweave.session import pinned
from listweave.sources.store import Store
from listweave.streaming.fetches import OpenPages, WholeFetch


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that owns a checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_incremental(
    landed: DataFrame,
    to_listings: Callable[[DataFrame], DataFrame],
    store: Store,
    checkpoint: str,
    arrival: list[str],
    query: str = "query",
    whole: WholeFetch | None = None,
) -> StreamingQuery:
    """Takes up all files that have landed and stops.

    Cutoff, cap and page end need the complete pages of a fetch, so ``to_listings`` works on them as
    a table. With ``whole`` a batch takes up the fetches that are whole by then, however their files
    fall into batches, and leaves the other pages open for later ones; without it each batch is a
    complete run. The run id is the id of the stream, which its checkpoint keeps, and the batch id:
    a batch repeated after a failure takes the place of its own run, and of no other stream's.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = f"{stream_id(spark, checkpoint)}-{batch_id:09d}"
        if whole is None:
            store.append_new(to_listings(batch), run, arrival, query)
            return
        held = OpenPages(spark, checkpoint)
        pages = pinned(held.before(batch_id, batch).unionByName(batch))
        done, still_open = whole.split(pages)
        if not done.isEmpty():
            store.append_new(to_listings(done), run, arrival, query)
        held.leave(still_open, batch_id)

    return (
        landed.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def take_open(
    like: DataFrame,
    to_listings: Callable[[DataFrame], DataFrame],
    store: Store,
    checkpoint: str,
    arrival: list[str],
    query: str = "query",
) -> None:
    """Stores what can be had of the fetches that a stopped stream has left open, as they are; they
    will not go on. ``like`` has the columns of the pages."""
    spark = like.sparkSession
    held = OpenPages(spark, checkpoint)
    pages = pinned(held.now(like))
    if not pages.isEmpty():
        run = f"{stream_id(spark, checkpoint)}-{held.last_batch():09d}-open"
        store.append_new(to_listings(pages), run, arrival, query)
        held.leave(pages.limit(0), held.last_batch())


def deduplicated_within(
    stream: DataFrame, keys: list[str], event_time: str, horizon: str
) -> DataFrame:
    """Drops repeats of a key that arrive within the horizon; the state stays bounded.

    A repeat after the horizon passes, so use it only where that is acceptable.
    """
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
