"""Steps that depend on the order in which items arrived: dedup, cutoff, cap, page end.

Spark rows have no order, so arrival is explicit: a list of sortable columns that is total
within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.operators.spread import group_join, numbered, ranged, totals_in_ranges

# Up to this cap Spark prunes each input partition to the first rows of a group before the shuffle.
# It decides between two plans with the same rows.
PRUNED_CAP = 1000


def place(arrival: list[str]) -> Column:
    """Arrival as one comparable value. A single number keeps aggregates on the hash path."""
    return F.col(arrival[0]) if len(arrival) == 1 else F.struct(*arrival)


def _fixed_width(items: DataFrame, names: list[str]) -> bool:
    types = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(items.schema[name].dataType, types) for name in names)


def fetches(pages: DataFrame, page: list[str], tie: list[str]) -> DataFrame:
    """Pages with ``fetch_no``: the how manieth time the page was fetched, by ``fetched_at``.

    A page that landed more than once from the same fetch stays once, the first by ``tie``.
    """
    landed = Window.partitionBy(*page)
    in_order = landed.orderBy("fetched_at", *tie)
    again = (F.row_number().over(in_order) > 1) & F.lag("fetched_at").over(in_order).eqNullSafe(
        F.col("fetched_at")
    )
    return (
        pages.select(
            "*",
            F.dense_rank().over(landed.orderBy("fetched_at")).alias("fetch_no"),
            again.alias("_again"),
        )
        .filter(~F.col("_again"))
        .drop("_again")
    )


def first_seen(items: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """First item of each key. An aggregate: every map task sends at most one row per key.

    If arrival is one number and nothing but numbers goes along, a hash aggregate takes the
    columns one by one; otherwise a sort aggregate takes the item as a whole.
    """
    rest = [c for c in items.columns if c not in key]
    at = place(arrival)
    if len(arrival) == 1 and _fixed_width(items, rest):
        firsts = [F.min(c) if c == arrival[0] else F.min_by(c, at) for c in rest]
        grouped = items.groupBy(*key).agg(*[f.alias(c) for f, c in zip(firsts, rest)])
        return grouped.select(*items.columns)
    grouped = items.groupBy(*key).agg(F.min_by(F.struct(*rest), at).alias("_first"))
    return grouped.select(
        *[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in items.columns]
    )


def until_old(items: DataFrame, group: list[str], old: str, arrival: list[str]) -> DataFrame:
    """Items of each group before its first old one: a prefix, not a filter. Null is not old."""
    is_old = F.coalesce(F.col(old), F.lit(False))
    stops = items.filter(is_old).groupBy(*group).agg(F.min(place(arrival)).alias("_stop"))
    return (
        group_join(items, stops, group, "left", arrival)
        .filter(F.col("_stop").isNull() | (place(arrival) < F.col("_stop")))
        .drop("_stop")
    )


def capped(items: DataFrame, group: list[str], arrival: list[str], count: int) -> DataFrame:
    """First ``count`` items of each group."""
    order = [F.col(c) for c in arrival]
    if count <= PRUNED_CAP:
        ranked = items.withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        )
    else:
        ranked = numbered(items, group, order, "_rank")
    return ranked.filter(F.col("_rank") <= count).drop("_rank")


def collected(
    items: DataFrame, group: list[str], old: str, arrival: list[str], count: int | None
) -> DataFrame:
    """Cutoff and cap on items without duplicates, with their ``rank`` in the group.

    With a small cap one window does both: the kept rows are a prefix of at most ``count`` rows,
    so the running test only has to see those, and Spark cuts each partition down to the first
    ``count`` rows of a group before the shuffle. With a large cap or none, the cutoff is one
    small table of stops and the ranks come from range partitions, which are written once. An item
    whose ``old`` is null is not old, either way.
    """
    order = [F.col(c) for c in arrival]
    if count is None or count > PRUNED_CAP:
        prefix = until_old(ranged(items, group, order), group, old, arrival)
        ranked = totals_in_ranges(prefix, group, order, F.lit(1).cast("bigint"), "rank")
        return ranked if count is None else ranked.filter(F.col("rank") <= count)
    in_order = Window.partitionBy(*group).orderBy(*order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        items.select(
            "*",
            F.row_number().over(in_order).cast("bigint").alias("rank"),
            F.max(F.coalesce(F.col(old), F.lit(False))).over(so_far).alias("_stopped"),
        )
        .filter((F.col("rank") <= count) & ~F.col("_stopped"))
        .drop("_stopped")
    )


def consumed_pages(
    pages: DataFrame,
    group: list[str],
    page: str,
    items: str,
    page_size: int,
    exempt: Column | None = None,
) -> DataFrame:
    """Pages up to and including the first short one of their group; an empty page is short.

    ``exempt`` pages are consumed whatever their size and end nothing.
    """
    exempt = F.lit(False) if exempt is None else exempt
    ends = (
        pages.filter((F.col(items) < page_size) & ~exempt)
        .groupBy(*group)
        .agg(F.min(page).alias("_end"))
    )
    return (
        group_join(pages, ends, group, "left", [page])
        .filter(exempt | F.col("_end").isNull() | (F.col(page) <= F.col("_end")))
        .drop("_end")
    )
