"""Mixing sources to target weights with a splitting tree.

Every source is cut into blocks of documents by hash. Its target says how many whole passes over
its blocks the mix takes and how many blocks of one more pass. The numbers of blocks per source are
split among the output shards by a tree of multivariate hypergeometric draws, each shard takes its
own stretch of the permuted blocks, and rows are shuffled within their shard.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm.common import fresh, with_row_id
from listweave.operators.spread import is_small
from listweave.session import pinned

MOST_REPEATS = 3
BLOCKS_PER_SOURCE = 1024
SEED = 17
PLAN = "source_no int, block int, pass int, shard int, budget bigint"


@dataclass(frozen=True)
class Source:
    name: str | None
    words: int
    rows: int


def targets(words: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Words to take of each source: all words shared by weight, no source above ``most`` times
    its own; what is cut off is shared again by weight among the others."""
    result = [0.0] * len(words)
    free = list(range(len(words)))
    budget = float(sum(words))
    while free:
        share = budget / sum(weights[i] for i in free)
        above = [i for i in free if share * weights[i] > most * words[i]]
        if not above:
            for i in free:
                result[i] = share * weights[i]
            break
        for i in above:
            result[i] = float(most * words[i])
            budget -= result[i]
        free = [i for i in free if i not in set(above)]
    return result


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: rows are shards, columns sum up to ``quotas``.

    A node hands its left half of the shards a sample, without return, of its blocks.
    """
    result = np.zeros((shards, len(quotas)), np.int64)

    def divide(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            result[first] = counts
            return
        middle = (first + last) // 2
        total = int(counts.sum())
        size = total * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(counts, size, method="marginals")
        divide(left, first, middle)
        divide(counts - left, middle, last)

    divide(quotas.astype(np.int64), 0, shards)
    return result


def draws(
    sizes: dict[int, int], target: float, total: int, seed: int
) -> list[tuple[int, int, int | None]]:
    """Blocks to take in order, as (block, pass, words to fill or None for the whole block)."""
    taken: list[tuple[int, int, int | None]] = []
    if total == 0:
        return taken
    blocks = np.array(sorted(sizes))
    whole = min(MOST_REPEATS, int(target // total))
    for turn in range(whole):
        order = np.random.default_rng([seed, turn]).permutation(blocks)
        taken += [(int(b), turn, None) for b in order]
    rest = round(target - whole * total)
    if rest <= 0 or whole == MOST_REPEATS:
        return taken
    over = None
    for block in np.random.default_rng([seed, whole]).permutation(blocks).tolist():
        if sizes[block] <= rest:
            taken.append((block, whole, None))
            rest -= sizes[block]
        elif over is None:
            over = block
    if over is not None and rest:
        taken.append((over, whole, rest))
    return taken


def source_seed(name: str | None, seed: int) -> int:
    return seed if name is None else (zlib.crc32(name.encode()) << 8) + seed


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block that fill its budget: from the largest on, each that still fits."""
    rows = rows.sort_values(["size", "place"], ascending=[False, True])
    left = int(rows["budget"].iloc[0])
    chosen = []
    for size in rows["size"].tolist():
        fits = size <= left
        chosen.append(fits)
        left -= size if fits else 0
    return rows.loc[chosen, ["row", "source_no", "block"]]


@dataclass
class Mix:
    """``sized``: rows with source, block and size. ``sources``: the sources with their targets and
    numbers of blocks. ``whole``: blocks taken whole, by source number, block, pass and shard.
    ``single``: single rows taken of the block that fills up a source, by row, pass and shard."""

    sized: DataFrame
    sources: DataFrame
    whole: DataFrame
    single: DataFrame


def place_of(seed: int):
    """Hash of a row that its block follows from."""
    return F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.lit(seed))


def _broadcast_if_small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if is_small(table) else table


def mix(rows: DataFrame, row_id: str, shards: int = 16, seed: int = SEED) -> Mix:
    """The mix of ``rows`` with unique numbers in ``row_id``, which are read once and stored.

    Sums of sources and blocks reach the driver, a mix being a list of sources with weights: up to
    ``BLOCKS_PER_SOURCE`` numbers a source, no more than the source has rows.
    """
    spark = rows.sparkSession
    sized = pinned(
        rows.select(
            F.col(row_id).alias("row"),
            "doc_id",
            F.col("source"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
            .cast("bigint")
            .alias("size"),
            place_of(seed).alias("place"),
        )
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    listed = [Source(r["source"], r["words"], r["rows"]) for r in found.collect()]
    listed.sort(key=lambda s: (s.name is None, s.name or ""))
    wanted = targets([s.words for s in listed], [1 + i % 3 for i in range(len(listed))])
    sources = spark.createDataFrame(
        [
            (i, s.name, s.words, t, min(BLOCKS_PER_SOURCE, s.rows))
            for i, (s, t) in enumerate(zip(listed, wanted, strict=True))
        ],
        "source_no int, source string, source_size bigint, target double, blocks int",
    )
    sources = _broadcast_if_small(pinned(sources.repartition(1)))
    blocked = pinned(
        sized.join(sources, sized["source"].eqNullSafe(sources["source"]))
        .drop("source")
        .withColumn("block", F.pmod("place", "blocks").cast("int"))
        .drop("blocks")
    )
    sizes: list[dict[int, int]] = [{} for _ in listed]
    for r in blocked.groupBy("source_no", "block").agg(F.sum("size").alias("words")).collect():
        sizes[r["source_no"]][r["block"]] = r["words"]
    per_source = [
        draws(of, t, s.words, source_seed(s.name, seed))
        for s, t, of in zip(listed, wanted, sizes, strict=True)
    ]
    shares = split_tree(np.array([len(d) for d in per_source], np.int64), shards, seed)
    plan_rows = []
    for number, taken in enumerate(per_source):
        shard_of = np.repeat(np.arange(shards), shares[:, number]).tolist()
        plan_rows += [
            (number, block, turn, shard, budget)
            for (block, turn, budget), shard in zip(taken, shard_of, strict=True)
        ]
    plan = pinned(spark.createDataFrame(plan_rows, PLAN).repartition(1))
    whole = plan.filter("budget is null").drop("budget")
    partly = plan.filter("budget is not null")
    single = (
        blocked.join(partly, ["source_no", "block"])
        .groupBy("source_no", "block")
        .applyInPandas(_filled, "row bigint, source_no int, block int")
        .join(partly.drop("budget"), ["source_no", "block"])
        .select("row", "pass", "shard")
    )
    return Mix(blocked, sources, whole, pinned(single))


def mixed(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Columns: ``doc_id``, ``size`` (words, zero for null text), ``source_size``, ``target`` (of the
    source), ``taken`` (words, repeats counted) and ``repeats``. Sources weigh 1, 2, 3, 1, … in
    order of code points, null being a source of its own and last. No row is taken more than three
    times. Rows without words are never short of a target and may be taken or not. Repeated rows
    and null ids count as rows of their own. Other columns are ignored, an empty table gives no
    rows, and the same rows give the same mix.
    """
    # The numbers are stored with the sizes; the texts themselves need not be.
    rows = docs.select("doc_id", "text", "source", F.monotonically_increasing_id().alias("number"))
    result = mix(rows, "number", shards, seed)
    block = ["source_no", "block"]
    of_block = result.whole.groupBy(*block).agg(F.count("*").alias("turns"))
    of_row = result.single.groupBy("row").agg(F.count("*").alias("more"))
    repeated = F.coalesce("turns", F.lit(0)) + F.coalesce("more", F.lit(0))
    return result.sized.join(of_block, block, "left").join(of_row, "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * repeated).alias("taken"),
        repeated.cast("int").alias("repeats"),
    )


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    A row lies in the partition of its output shard, and each shard is in an order of its own. Rows
    find their draws by source and block, tables that do not grow with the rows, so the texts are
    shuffled once, to their shards.
    """
    rows, row_id = with_row_id(docs)
    result = mix(rows, row_id, shards, seed)
    number, block, place, blocks, name, shard, turn = (
        fresh(rows, n)
        for n in ("_source_no", "_block", "_place", "_blocks", "_name", "_shard", "_pass")
    )
    sources = result.sources.select(
        F.col("source_no").alias(number), F.col("source").alias(name), F.col("blocks").alias(blocks)
    )
    drawn = [F.col("pass").alias(turn), F.col("shard").alias(shard)]
    whole = result.whole.select(
        F.col("source_no").alias(number), F.col("block").alias(block), *drawn
    )
    single = result.single.select(F.col("row").alias(row_id), *drawn)
    columns = [*rows.columns, shard, turn]
    by_block = (
        rows.withColumn(place, place_of(seed))
        .join(_broadcast_if_small(sources), F.col("source").eqNullSafe(F.col(name)))
        .withColumn(block, F.pmod(place, blocks).cast("int"))
        .join(_broadcast_if_small(whole), [number, block])
    )
    by_row = rows.join(_broadcast_if_small(single), row_id)
    return (
        by_block.select(*columns)
        .unionByName(by_row.select(*columns))
        .repartition(shards, shard)
        .sortWithinPartitions(shard, F.xxhash64(row_id, turn, F.lit(seed)))
        .select(*docs.columns)
    )
