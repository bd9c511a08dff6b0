"""Greedy dedup on two keys.

In arrival order, an item is kept unless one of its two keys has been taken; a kept item takes
both keys, a dropped one takes none. That depends on order, but only among items that are connected
by shared keys:

* a group that fits in one task is taken in order there;
* of larger ones most items are settled at once, by aggregates and joins: one that is the earliest
  undecided item on each of its keys is kept, and what shares a key with a kept item is dropped;
* each round is taken on fewer items. Where rounds no longer settle much, as in long chains, what is
  left falls apart in components of items that share keys. Components are packed into tasks of
  bounded size, each taken in order, all in one turn;
* a component that is too large for a task is taken in slices, one after the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listweave.operators.components import component_of
from listweave.operators.spread import (
    ROWS_PER_SALT,
    group_join,
    hot_keys,
    numbered,
    salted_join,
)
from listweave.session import pinned

# Most parallel rounds before components are looked for, and the share of the undecided items that a
# round has to settle for another one to follow.
ROUNDS = 30
LEAST_SETTLED = 0.2
# Undecided items that one task settles in order; a larger component takes several turns.
SLICE_ROWS = 250_000


def _group_number(group: list[str]) -> Column:
    """The group as one text that is never null."""
    parts = [
        F.when(F.col(c).isNull(), "-").otherwise(
            F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string"))
        )
        for c in group
    ]
    return F.concat(*parts)


def _keys(items: DataFrame, group: list[str]) -> DataFrame:
    """One row per key of each item."""
    keys = F.array_distinct(F.array("_a", "_b"))
    return items.select(*group, "_at", F.explode(keys).alias("_key"))


def _with_own_keys(items: DataFrame, group: list[str]) -> DataFrame:
    """Items without an empty second key.

    An empty second key is looked up but never taken, and only items without any key take the
    empty one. The first of those is always kept, so it drops the look-ups that come later; the
    earlier ones find the key free and count by their first key alone.
    """
    looks_up = (F.col("_b") == "") & (F.col("_a") != "")
    if items.filter(looks_up).isEmpty():
        return items
    empties = items.filter(F.col("_a") == "").groupBy(*group).agg(F.min("_at").alias("_empty"))
    too_late = F.coalesce(F.col("_at") > F.col("_empty"), F.lit(False))
    return (
        group_join(items, empties, group, "left", ["_at"])
        .filter(~(looks_up & too_late))
        .withColumn("_b", F.when(looks_up, F.col("_a")).otherwise(F.col("_b")))
        .drop("_empty")
    )


def _firsts(undecided: DataFrame, group: list[str]) -> DataFrame:
    """The earliest item ``_at`` of each key, the number ``_of`` of keys that item has, and how many
    items have the key."""
    n_keys = F.when(F.col("_a") == F.col("_b"), 1).otherwise(2)
    both = F.array_distinct(F.array("_a", "_b"))
    keys = undecided.select(*group, "_at", n_keys.alias("_of"), F.explode(both).alias("_key"))
    return keys.groupBy(*group, "_key").agg(
        F.min("_at").alias("_at"), F.min_by("_of", "_at").alias("_of"), F.count("*").alias("_n")
    )


def _taken(firsts: DataFrame, group: list[str]) -> DataFrame:
    """Keys that are taken by items that are the earliest on all their keys, with these items."""
    named = F.count("*").over(Window.partitionBy(*group, "_at"))
    kept = firsts.withColumn("_named", named).filter(F.col("_named") == F.col("_of"))
    return kept.select(*group, "_key", "_at")


def _not_taken(
    items: DataFrame, taken: DataFrame, group: list[str], hot: DataFrame | None = None
) -> DataFrame:
    """Items neither of whose keys is taken; ``hot`` keys are split."""
    for side in ("_a", "_b"):
        split = None if hot is None else hot.withColumnRenamed("_key", side)
        of_side = taken.withColumnRenamed("_key", side)
        items = salted_join(items, of_side, [*group, side], "left_anti", ["_at"], split)
    return items


def _in_order(items: DataFrame, together: str) -> DataFrame:
    """The rule applied in order to items of bounded number with one value of ``together``: what is
    kept. They may be of several groups."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        taken: dict[str, set[str]] = {g: set() for g in pdf["_g"].unique()}
        kept = []
        for g, a, b in zip(pdf["_g"], pdf["_a"], pdf["_b"]):
            free = a not in taken[g] and b not in taken[g]
            kept.append(free)
            if free:
                taken[g].update((a, b))
        return pdf.loc[kept, ["_g", "_at", "_a", "_b"]]

    narrow = items.select("_g", "_at", "_a", "_b", together)
    return narrow.groupBy(together).applyInPandas(keep, narrow.drop(together).schema)


def _in_slices(
    items: DataFrame, together: str, slice_rows: int, rows_per_salt: int
) -> list[DataFrame]:
    """The rule applied to components of any size, in slices of ``slice_rows`` items of each in
    order; each slice leaves out what the slices before it have taken."""
    placed = numbered(items, [together], [F.col("_at")], "_n")
    queued = pinned(
        placed.withColumn("_slice", F.floor((F.col("_n") - 1) / slice_rows)).drop("_n")
    )
    last = queued.agg(F.max("_slice")).first()[0]
    kept: list[DataFrame] = []
    for number in range((-1 if last is None else last) + 1):
        now = pinned(_in_order(queued.filter(F.col("_slice") == number), together))
        kept.append(now.select("_g", "_at"))
        if number < last:
            later = queued.filter(F.col("_slice") > number)
            taken = _keys(now, ["_g"]).drop("_at")
            counts = _keys(later, ["_g"]).groupBy("_g", "_key").agg(F.count("*").alias("_n"))
            queued = pinned(_not_taken(later, taken, ["_g"], hot_keys(counts, rows_per_salt)))
    return kept


def _with_component(items: DataFrame) -> DataFrame:
    """Items with ``_root``: equal for items that are connected by shared keys of their group. Keys
    are told apart by a hash; where two fall together, two components are taken as one."""
    node = {side: F.xxhash64("_g", side) for side in ("_a", "_b")}
    roots = pinned(component_of(items.select(node["_a"].alias("a"), node["_b"].alias("b"))))
    with_node = items.withColumn("node", node["_a"])
    return (
        with_node.join(roots, "node", "left")
        .withColumn("_root", F.coalesce("root", "node"))
        .drop("node", "root")
    )


def _by_components(items: DataFrame, slice_rows: int, rows_per_salt: int) -> list[DataFrame]:
    """The rule applied to each component on its own."""
    connected = pinned(_with_component(items))
    sizes = pinned(connected.groupBy("_root").agg(F.count("*").alias("_n")))
    giants = sizes.filter(F.col("_n") > slice_rows)
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    kept: list[DataFrame] = []
    small = connected
    if most > slice_rows:
        # Items of a giant are many, giants are fewer than items over ``slice_rows``.
        small = connected.join(giants, "_root", "left_anti")
        large = connected.join(giants.select("_root"), "_root", "left_semi")
        kept = _in_slices(large, "_root", slice_rows, rows_per_salt)
    packs = max(1, -(-total // slice_rows))
    packed = small.withColumn("_pack", F.pmod(F.xxhash64("_root"), F.lit(packs)))
    return [*kept, _in_order(packed, "_pack").select("_g", "_at")]


def greedy_two_key(
    items: DataFrame,
    group: list[str],
    first: str,
    second: str,
    arrival: list[str],
    unique_arrival: bool = False,
    rounds: int = ROUNDS,
    slice_rows: int = SLICE_ROWS,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Items kept by the greedy rule. Both key columns are text and share one name space; an item
    with an empty first key has an empty second one, and null keys are empty. Null groups are a
    group like any other.

    Items are numbered in order of arrival, ties by their keys, unless ``unique_arrival`` says that
    ``arrival`` is one bigint without nulls and repeats in a group. As long as a group has more than
    ``slice_rows`` undecided items, there are up to ``rounds`` rounds, and no more after one that
    settled little; what is left then is settled by components, packed into tasks of about
    ``slice_rows`` items. Only a component with more items than that takes several turns.

    ``items`` is read more than once, so it should be a stored table or little work away from one.
    """
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (first, second))
    placed = items.withColumns({"_g": _group_number(group), "_a": a, "_b": b})
    if unique_arrival:
        placed = placed.withColumn("_at", F.col(arrival[0]).cast("bigint"))
    else:
        order = [*[F.col(c) for c in arrival], F.col("_a"), F.col("_b")]
        # Numbers that grow with the order are enough, so that one sort gives them.
        order.append(F.col("_g"))
        in_order = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = pinned(in_order.withColumn("_at", F.monotonically_increasing_id()))
    group = ["_g"]
    undecided = _with_own_keys(placed.select("_g", "_a", "_b", "_at"), group)
    kept: list[DataFrame] = []

    def most_left() -> int:
        return undecided.groupBy("_g").count().agg(F.max("count")).first()[0] or 0

    left = most_left()
    for _ in range(rounds):
        if left <= slice_rows:
            break
        firsts = pinned(_firsts(undecided, group))
        taken = pinned(_taken(firsts, group))
        kept.append(taken.select(*group, "_at").distinct())
        hot = hot_keys(firsts.select(*group, "_key", "_n"), rows_per_salt)
        undecided = pinned(_not_taken(undecided, taken.drop("_at"), group, hot))
        before, left = left, most_left()
        if left > (1 - LEAST_SETTLED) * before:
            break
    if left > slice_rows:
        kept += _by_components(undecided, slice_rows, rows_per_salt)
    elif left:
        kept.append(_in_order(undecided.withColumn("_one", F.col("_g")), "_one").select("_g", "_at"))
    if not kept:
        return items.filter(F.lit(False))
    survivors = kept[0]
    for more in kept[1:]:
        survivors = survivors.unionByName(more)
    return placed.join(survivors, ["_g", "_at"], "left_semi").select(*items.columns)
