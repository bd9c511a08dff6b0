"""Amounts as text. Rounding is half-even on exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listweave.functions.text import MISSING, filled

AMOUNT = "decimal(18,2)"


def _rounded(amount: Column, digits: int) -> Column:
    return F.bround(amount, digits).cast(f"decimal(28,{digits})").cast("string")


def spend_band(amount: Column) -> Column:
    """``$1.2M+``, ``$5K+`` or ``$950``; empty for nothing spent."""
    exact = amount.try_cast("decimal(28,8)")
    return (
        F.when(exact.isNull() | (exact == 0), "")
        .when(exact >= 1_000_000, F.concat(F.lit("$"), _rounded(exact / 1_000_000, 1), F.lit("M+")))
        .when(exact >= 1_000, F.concat(F.lit("$"), _rounded(exact / 1_000, 0), F.lit("K+")))
        .otherwise(F.concat(F.lit("$"), _rounded(exact, 0)))
    )


def plain_number(literal: Column) -> Column:
    """Parsed JSON numbers from ten million on come as ``1.5E7``; written out as ``15000000.0``."""
    exact = F.rtrim(literal.try_cast("decimal(38,12)").cast("string"), F.lit("0"))
    whole = F.concat(exact, F.when(exact.endswith("."), "0").otherwise(""))
    return F.when(literal.rlike(r"^-?\d\.\d+E\d+$"), F.coalesce(whole, literal)).otherwise(literal)


def _nonzero(amount: Column) -> Column:
    """Null for missing, empty or zero amounts; otherwise the number as text."""
    is_set = F.coalesce(amount.try_cast("double") != 0, filled(amount).isNotNull())
    return F.when(is_set, plain_number(amount))


def _hourly(low: Column, high: Column) -> Column:
    return F.concat(F.lit("$"), low, F.lit("-$"), high, F.lit("/hr"))


def state_budget(kind: Column, low: Column, high: Column, amount: Column) -> Column:
    """Budget of a page-state job: a missing side of an hourly range prints ``0``."""
    low, high, amount = _nonzero(low), _nonzero(high), _nonzero(amount)
    zero = F.lit("0")
    hourly = F.when(
        low.isNotNull() | high.isNotNull(),
        _hourly(F.coalesce(low, zero), F.coalesce(high, zero)),
    )
    fixed = F.concat(F.lit("$"), amount)
    return F.coalesce(F.when(kind == "HOURLY", hourly).otherwise(fixed), F.lit(MISSING))


def api_budget(kind: Column, low: Column, high: Column, amount: Column) -> Column:
    """Budget of an API job: a missing side of an hourly range prints ``?``."""
    unknown = F.lit("?")
    low, high, amount = plain_number(low), plain_number(high), plain_number(amount)
    hourly = _hourly(F.coalesce(low, unknown), F.coalesce(high, unknown))
    fixed = F.coalesce(F.concat(F.lit("$"), amount), F.lit(MISSING))
    return F.when(kind == "HOURLY", hourly).otherwise(fixed)


def api_budget_exact(kind: Column, job_fields: Column) -> Column:
    """As :func:`api_budget`, but a JSON null side prints ``None`` and an absent one ``?``.

    ``job_fields`` is the inner object parsed as ``map<string, string>``, which keeps null entries.
    """

    def side(name: str) -> Column:
        return F.when(
            F.map_contains_key(job_fields, name),
            F.coalesce(F.element_at(job_fields, name), F.lit("None")),
        ).otherwise("?")

    amount = F.get_json_object(F.element_at(job_fields, "fixedPriceAmount"), "$.amount")
    exact = _hourly(side("hourlyBudgetMin"), side("hourlyBudgetMax"))
    return F.when(kind == "HOURLY", exact).otherwise(
        F.coalesce(F.concat(F.lit("$"), amount), F.lit(MISSING))
    )


def two_decimals(number: Column) -> Column:
    """``4.90`` style text; empty for null."""
    return F.coalesce(_rounded(number.try_cast("decimal(28,10)"), 2), F.lit(""))


def whole_number(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit(""))


def budget_bounds(budget: Column) -> tuple[Column, Column]:
    """Lowest and highest amount named in a budget text."""
    numbers = F.regexp_extract_all(budget, F.lit(r"\$(\d+(?:\.\d+)?)"), F.lit(1))
    amounts = F.transform(numbers, lambda n: n.try_cast(AMOUNT))
    return F.array_min(amounts), F.array_max(amounts)
