"""Requests that a fetcher would make: one row per query and page offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listweave.operators.filters import Facets
from listweave.schemas import API_PAGE_SIZE, CARD_PAGE_SIZE


def form_encoded(text: Column) -> Column:
    """Form encoding: blanks as ``+``; ``*`` is encoded and ``~`` is not."""
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def with_offsets(queries: DataFrame, pages: int, page_size: int) -> DataFrame:
    offsets = F.array(*[F.lit(page * page_size).cast("bigint") for page in range(pages)])
    return queries.withColumn("start", F.explode(offsets))


def card_requests(
    queries: DataFrame,
    pages: int,
    facets: Facets | None = None,
    days: int | None = None,
    query: str = "query",
    location: Column | None = None,
    page_size: int = CARD_PAGE_SIZE,
) -> DataFrame:
    """Adds ``start`` and the encoded ``parameters``, newest first.

    ``location`` takes the place from the row instead of from the facets.
    """
    fixed = (facets or Facets()).parameters(days)
    # Parameter names and the sort order.
    named = {
        "keywords": F.col(query),
        "start": F.col("start").cast("string"),
        "sortBy": F.lit("DD"),
        **{name: F.lit(value) for name, value in fixed.items()},
    }
    if location is not None:
        rest = {n: v for n, v in named.items() if n.startswith("f_")}
        named = {n: named[n] for n in ("keywords", "start", "sortBy")}
        named |= {"location": location, **rest}
    pairs = [
        F.concat(F.lit(name + "="), form_encoded(value)) for name, value in named.items()
    ]
    return with_offsets(queries, pages, page_size).withColumn(
        "parameters", F.concat_ws("&", *pairs)
    )


def api_requests(
    queries: DataFrame, pages: int, query: str = "query", page_size: int = API_PAGE_SIZE
) -> DataFrame:
    """Adds ``start`` and the request ``variables`` as JSON."""
    request = F.struct(
        F.col(query).alias("userQuery"),
        F.lit("recency").alias("sort"),
        F.struct(
            F.col("start").alias("offset"), F.lit(page_size).cast("bigint").alias("count")
        ).alias("paging"),
    )
    variables = F.to_json(F.struct(request.alias("requestVariables")))
    return with_offsets(queries, pages, page_size).withColumn("variables", variables)
