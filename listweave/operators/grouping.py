"""Listings of several queries side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.operators.spread import group_join, numbered


def by_query(listings: DataFrame, query: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` and ``n_items``: every query's listings in order, nulls last, without
    gathering a query in one row.

    The listings themselves are numbered, so rows of equal order get a place each, in any order
    among them. Null queries are a query like any other.
    """
    in_order = [F.col(c).asc_nulls_last() for c in order]
    places = numbered(listings, [query], in_order, "pos")
    sizes = listings.groupBy(query).agg(F.count("*").alias("n_items"))
    return group_join(places, sizes, [query], "left", order)


def ordered_union(branches: list[DataFrame]) -> DataFrame:
    """Union in which ``branch`` puts all rows of one input before those of the next."""
    ranked = [df.withColumn("branch", F.lit(i)) for i, df in enumerate(branches)]
    union = ranked[0]
    for more in ranked[1:]:
        union = union.unionByName(more)
    return union
