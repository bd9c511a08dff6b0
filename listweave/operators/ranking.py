"""Filters and ranking on collected listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.functions.money import budget_bounds
from listweave.operators.arrival import capped


def budget_at_least(
    df: DataFrame, budget: Column, minimum: int, excluded: list[str], *texts: Column
) -> DataFrame:
    """Listings that name an amount of at least ``minimum`` and none of the excluded words."""
    _, highest = budget_bounds(budget)
    kept = df.filter(highest >= minimum)
    for text in texts:
        for word in excluded:
            kept = kept.filter(~F.lower(F.coalesce(text, F.lit(""))).contains(word.lower()))
    return kept


def relevance(terms: list[str], title: Column, text: Column) -> Column:
    """Two points for a term in the title, one for a term in the text."""
    score = F.lit(0)
    for term in terms:
        for weight, field in ((2, title), (1, text)):
            score = score + F.when(F.lower(field).contains(term.lower()), weight).otherwise(0)
    return score.cast("bigint")


def most_relevant(
    df: DataFrame, group: list[str], score: Column, ties: list[Column], count: int
) -> DataFrame:
    """Top listings of each group that have any relevance; ties by the given columns."""
    names = [f"_tie{i}" for i in range(len(ties))]
    scored = df.withColumn("score", score).filter(F.col("score") > 0)
    ordered = scored.select(
        "*", (-F.col("score")).alias("_order"), *[t.alias(n) for t, n in zip(ties, names)]
    )
    return capped(ordered, group, ["_order", *names], count).drop("_order", *names)
