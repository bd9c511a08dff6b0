"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.session import pinned

MOST_ROUNDS = 100
LINKS_AT_ONCE = 500_000
LINKS = "a bigint, b bigint"


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 … n-1 the smallest node that links ``a[i]``-``b[i]`` lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while not np.array_equal(hooked, hooked[hooked]):
            hooked = hooked[hooked]
        if np.array_equal(hooked, label):
            return label
        label = hooked


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links with the same components: every node with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(nodes), ends[: len(a)], ends[len(a) :])
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def star_batches(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links gathered up to a bounded number, each bounded lot reduced to stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def reduced() -> pa.RecordBatch:
        a, b = stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for a, b in links:
        held.append((a, b))
        size += len(a)
        if size >= LINKS_AT_ONCE:
            batch = reduced()
            yield batch
            held, size = [], 0
    if size:
        yield reduced()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from star_batches(
        (batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if len(batch)
    )


def components(links: DataFrame, reduced: bool = False) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``, two different bigints.

    Nodes with the same root are connected. Each round every node points to its lowest neighbour,
    pointers are followed once more, and links between different targets go on. Rounds take the
    order of the numbers and a random order in turns: the first finishes stars at once, the second
    leaves a fixed share of any other shape. Each task first reduces its own links to stars, unless
    they are ``reduced`` by :func:`star_batches` already: each task would need a second Python worker
    to do it again. All tables are written, so nothing is computed again. Nulls are not allowed; no
    links give no rows.
    """
    maps: list[DataFrame] = []
    left = links.select("a", "b")
    left = pinned(left if reduced else left.mapInArrow(_contracted, LINKS))
    while links_left := left.count():
        if len(maps) == MOST_ROUNDS:
            raise RuntimeError(f"links are left after {MOST_ROUNDS} rounds")
        turn = len(maps)

        def place(node, turn=turn):
            return F.xxhash64(node, F.lit(turn)) if turn % 2 else node

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("node")).agg(
            F.min(F.struct(place(F.col("b")).alias("place"), F.col("b").alias("other"))).alias("low")
        )
        first = pinned(
            lowest.select(
                "node",
                F.when(F.col("low.place") < place(F.col("node")), F.col("low.other"))
                .otherwise(F.col("node"))
                .alias("parent"),
            ),
            2 * links_left,
        )
        above = first.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = pinned(first.join(above, "parent").select("node", "root"), 2 * links_left)
        maps.append(step)
        left = pinned(
            left.join(step.toDF("a", "ra"), "a")
            .join(step.toDF("b", "rb"), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
            .mapInArrow(_contracted, LINKS),
            links_left,
        )
    if not maps:
        return links.sparkSession.createDataFrame([], "node bigint, root bigint")
    result = maps[-1]
    for step in reversed(maps[:-1]):
        later = result.toDF("root", "last")
        result = step.join(later, "root", "left").select(
            "node", F.coalesce("last", "root").alias("root")
        )
    return result
