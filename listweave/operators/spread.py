"""Joins and running totals that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listweave.session import pinned

BROADCAST_BYTES = 64 * 1024 * 1024
MOST_BROADCAST_ROWS = 2_000_000
ROWS_PER_SALT = 1_000_000
def null_safe_join(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on equal keys, where null equals null. The key columns are those of ``rows``."""
    other = {c: f"_of_{c}" for c in on}
    same = F.lit(True)
    for key, renamed in other.items():
        same = same & F.col(key).eqNullSafe(F.col(renamed))
    return rows.join(table.withColumnsRenamed(other), same, how).drop(*other.values())


def is_small(table: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table may be broadcast, by its measured rows and bytes."""
    size = table.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    return size["rows"] <= MOST_BROADCAST_ROWS and (size["bytes"] or 0) <= most_bytes


def hot_keys(counts: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame | None:
    """Keys with more than ``rows_per_salt`` rows and the number of parts to cut each into.

    ``counts`` has the key columns and ``_n``. None if there is no hot key.
    """
    hot = counts.filter(F.col("_n") > rows_per_salt).withColumn(
        "_parts", F.ceil(F.col("_n") / rows_per_salt).cast("int")
    )
    stored = pinned(hot.drop("_n"))
    return None if stored.isEmpty() else stored


def _with_parts(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``_parts`` of each row's key, null for keys that are not hot. There is a hot key per
    ``rows_per_salt`` rows at most, but that may still be too many for a broadcast."""
    table = F.broadcast(hot) if is_small(hot) else hot
    return null_safe_join(df, table, on, "left")


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    hot: DataFrame | None,
) -> DataFrame:
    """Join ``rows`` with ``table`` so that no hot key of ``rows`` ends up in a single task.

    Rows of a hot key are cut into parts by a hash of the ``spread`` columns, and its ``table``
    rows are repeated once per part. All other keys take the plain way.
    """
    if hot is None:
        return null_safe_join(rows, table, on, how)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_rows = (
        _with_parts(rows, hot, on)
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("_parts")
    )
    salted_table = (
        _with_parts(table, hot, on)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return null_safe_join(salted_rows, salted_table, [*on, "_salt"], how).drop("_salt")


def stored_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``rows`` with a stored ``table`` that has a row per key: broadcast if the table is
    measured to be small, salted otherwise. Null keys equal each other, either way."""
    if is_small(table, broadcast_bytes):
        return null_safe_join(rows, F.broadcast(table), on, how)
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    return salted_join(rows, table, on, how, spread, hot_keys(counts, rows_per_salt))


def group_join(
    rows: DataFrame, table: DataFrame, on: list[str], how: str, spread: list[str], **limits: int
) -> DataFrame:
    """As :func:`stored_join`, for a ``table`` that is still to be computed."""
    return stored_join(rows, pinned(table), on, how, spread, **limits)


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned on group and order, with their partition number in ``_part``.

    A large group covers several partitions. The rows are pinned, as the numbers must not change.
    Null groups are a group like any other. The order must be total.
    """
    in_ranges = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return pinned(in_ranges.withColumn("_part", F.spark_partition_id()))


def totals_in_ranges(
    rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` within each group of ``ranged`` rows.

    Each partition sums on its own. What the earlier partitions of the same group add is a table
    with fewer rows than there are partitions, because a boundary lies in one group only.
    """
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy(*group, "_part")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_carried", F.sum("_sum").over(earlier))
        .filter(F.col("_carried").isNotNull())
        .drop("_sum")
    )
    within = (
        Window.partitionBy(*group, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_local", F.sum(value).over(within))
    return (
        null_safe_join(local, F.broadcast(carried), [*group, "_part"], "left")
        .withColumn(name, F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0)))
        .drop("_local", "_carried", "_part")
    )


def running_total(
    df: DataFrame, group: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` within each group, however large the group."""
    return totals_in_ranges(ranged(df, group, order), group, order, value, name)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Position from 1 within each group, however large the group."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), name)
