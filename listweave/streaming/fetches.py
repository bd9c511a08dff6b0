"""Pages of a stream held back until their fetch is whole.

A fetch reads the pages of a query from the first one to a short one. Its files may fall into several
micro-batches, but cutoff, cap and page end need all of them at once. Pages of fetches that are not
whole yet wait in a table next to the stream's checkpoint, one folder per batch: batch n reads what
batch n-1 left open, so a batch that is repeated after a failure finds the same pages again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listweave.operators.arrival import fetches
from listweave.operators.spread import null_safe_join
from listweave.session import pinned, remove_folder
from listweave.sources.commits import Commits


@dataclass(frozen=True)
class WholeFetch:
    """When the fetch of a query is whole: with a page for which ``ends`` holds and all pages from
    ``first_page`` to there. A query's fetch is also over if a later one of it is whole, or if its
    last page is older by ``patience`` than the newest page of the stream.

    ``page`` is what tells the pages of a query apart. Pages for which ``exempt`` holds have no place
    in the count; they should land no later than the page that ends their fetch.
    """

    ends: Column
    page: tuple[str, ...] = ("query", "page_no")
    query: str = "query"
    number: str = "page_no"
    first_page: int = 0
    exempt: Column | None = None
    patience: str | None = None

    def split(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored pages of whole fetches, and the others. The n-th landing of a page, by time, is of
        the query's n-th fetch. All is decided on narrow columns; payloads are not shuffled."""
        exempt = F.lit(False) if self.exempt is None else F.coalesce(self.exempt, F.lit(False))
        landing = list(dict.fromkeys([*self.page, "fetched_at", "_digest"]))
        marked = pages.withColumn("_digest", F.xxhash64(*pages.columns))
        narrow = marked.select(
            *dict.fromkeys([*landing, self.query, self.number]),
            F.coalesce(self.ends, F.lit(False)).alias("_ends"),
            exempt.alias("_exempt"),
        )
        numbered = pinned(fetches(narrow, list(self.page), ["_digest"]))
        group = [self.query, "fetch_no"]
        in_order = Window.partitionBy(*group).orderBy(self.number)
        complete = (
            numbered.filter(~F.col("_exempt"))
            .groupBy(*group, self.number)
            .agg(F.max("_ends").alias("_ends"))
            .withColumn("_place", F.row_number().over(in_order) - 1 + self.first_page)
            .filter(F.col("_ends") & (F.col("_place") == F.col(self.number)))
            .groupBy(self.query)
            .agg(F.max("fetch_no").alias("_whole"))
        )
        known = null_safe_join(numbered, complete, [self.query], "left")
        over = F.coalesce(F.col("fetch_no") <= F.col("_whole"), F.lit(False))
        if self.patience is not None:
            newest = numbered.agg(F.max("fetched_at")).first()[0]
            last = F.max("fetched_at").over(Window.partitionBy(*group))
            given_up = last < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.patience}")
            over = over | F.coalesce(given_up, F.lit(False))
        # A page that landed again from the same fetch has the same place in time; only one landing
        # has a number, and the others go with it.
        done = pinned(
            known.withColumn("_over", over)
            .filter("_over")
            .select(*dict.fromkeys([*self.page, "fetched_at"]))
            .distinct()
        )
        on = done.columns
        whole = null_safe_join(pages, done, on, "left_semi")
        return whole, null_safe_join(pages, done, on, "left_anti")


class OpenPages:
    """The table of pages that wait, next to a checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark = spark
        self.folder = f"{checkpoint}/open_pages"
        self.commits = Commits(spark, checkpoint)

    def _batches(self) -> list[int]:
        names = [n.removeprefix("batch=") for n in self.commits.names(self.folder)]
        whole = [n for n in names if self.commits.names(f"{self.folder}/batch={n}")[:1] == ["_SUCCESS"]]
        return sorted(int(n) for n in whole)

    def before(self, batch_id: int, like: DataFrame) -> DataFrame:
        """What the batches before this one have left open."""
        earlier = [n for n in self._batches() if n < batch_id]
        if not earlier:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/batch={earlier[-1]}")

    def leave(self, pages: DataFrame, batch_id: int) -> None:
        """Keeps the pages for the next batch; what a batch that may yet be repeated reads stays."""
        pages.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        for old in [n for n in self._batches() if n < batch_id][:-1]:
            remove_folder(self.spark, f"{self.folder}/batch={old}")

    def now(self, like: DataFrame) -> DataFrame:
        """The pages that wait now."""
        return self.before(1 << 62, like)

    def last_batch(self) -> int:
        return max(self._batches(), default=-1)
