"""Details that land after their listing was stored, or before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listweave.session import pinned
from listweave.sources.store import Store
from listweave.streaming.fetches import OpenPages


def latest_of(details: DataFrame, key: str) -> DataFrame:
    """The latest landing of each key, by ``fetched_at``; decided on narrow columns. Equal landings
    come each."""
    marked = details.withColumn("_digest", F.xxhash64("payload"))
    last = (
        marked.select(key, "fetched_at", "_digest")
        .groupBy(key)
        .agg(F.max(F.struct("fetched_at", "_digest")).alias("_last"))
        .select(F.col(key).alias("_key"), "_last")
    )
    same = (
        F.col(key).eqNullSafe(F.col("_key"))
        & F.col("fetched_at").eqNullSafe(F.col("_last.fetched_at"))
        & (F.col("_digest") == F.col("_last._digest"))
    )
    return marked.join(last, same, "left_semi").drop("_digest")


def take_details(
    landed: DataFrame,
    parsed: Callable[[DataFrame], DataFrame],
    store: Store,
) -> DataFrame:
    """Writes what ``parsed`` makes of the latest details into the records of their keys, and returns
    the details whose keys are not stored yet."""
    key = store.key
    pages = pinned(latest_of(landed, key))
    stored = pinned(store.known(pages.select(key)))
    now = pages.join(stored, key, "left_semi")
    if not stored.isEmpty():
        store.amended(parsed(now).dropDuplicates([key]))
    return pages.join(stored, key, "left_anti")


def start_details(
    landed: DataFrame,
    parsed: Callable[[DataFrame], DataFrame],
    store: Store,
    checkpoint: str,
) -> StreamingQuery:
    """Takes up all files of details that have landed and stops.

    ``landed`` has the store's key, ``payload`` and ``fetched_at``; ``parsed`` gives the key and the
    columns to be written. A detail fills its record, whenever that was stored; one whose listing is
    not stored yet waits next to the checkpoint, as open pages do, and is tried again with every
    later batch. Of details of one key the last one to land counts, by ``fetched_at`` within a batch
    and among those that wait. A batch that is repeated writes the same again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        held = OpenPages(batch.sparkSession, checkpoint)
        pages = pinned(held.before(batch_id, batch).unionByName(batch))
        held.leave(take_details(pages, parsed, store), batch_id)

    return (
        landed.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_open(
    like: DataFrame, parsed: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str
) -> None:
    """Tries the waiting details of a stopped stream again, after more listings were stored."""
    held = OpenPages(like.sparkSession, checkpoint)
    pages = pinned(held.now(like))
    if not pages.isEmpty():
        left = pinned(take_details(pages, parsed, store))
        held.leave(left, held.last_batch())
