"""Text rules of the records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listweave.schemas import JOB_LINK_BASE

# The mark of a missing text, the length of an excerpt, the number of skills.
MISSING = "N/A"
EXCERPT_CHARS = 500
TOP_SKILLS = 5


def filled(text: Column) -> Column:
    """Null for empty text."""
    return F.nullif(text, F.lit(""))


def first_filled(*choices: Column, default: str | None = None) -> Column:
    """The first choice that is neither null nor empty."""
    picked = [filled(c) for c in choices]
    if default is not None:
        picked.append(F.lit(default))
    return F.coalesce(*picked)


# White space at the ends of a text, of any kind; ``trim`` alone takes blanks only.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.left(stripped(F.coalesce(text, F.lit(""))), F.lit(chars))


def experience_level(raw: Column) -> Column:
    """One label per seniority text; the first matching word decides."""
    low = F.lower(raw)
    return (
        F.when(filled(raw).isNull(), MISSING)
        .when(low.contains("expert"), "Expert")
        .when(low.contains("intermediate") | low.contains("mid"), "Intermediate")
        .when(low.contains("entry") | low.contains("basic"), "Entry")
        .otherwise(raw)
    )


def job_type(code: Column) -> Column:
    """1 is hourly, 2 fixed."""
    number = code.try_cast("double")
    return F.when(number == 1, "HOURLY").when(number == 2, "FIXED").otherwise(MISSING)


def top_skills(names: Column, count: int = TOP_SKILLS) -> Column:
    """Blanks among the first names are dropped after the cut, so fewer may remain."""
    leading = F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, count)
    return F.array_join(F.filter(leading, lambda name: name != ""), ", ")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").when(~flag, "No").otherwise("")


def job_url(cipher: Column, base: str = JOB_LINK_BASE) -> Column:
    return F.when(cipher != "", F.concat(F.lit(base), cipher)).otherwise(MISSING)


def without_query(url: Column) -> Column:
    """The part before the first question mark."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def urn_tail(urn: Column, separator: str = ":") -> Column:
    """The part after the last separator."""
    return F.substring_index(urn, separator, -1)


def stripped_cipher(cipher: Column, strip_version: bool = False) -> Column:
    """Key form of a cipher.

    By default all leading ``~`` and ``0`` characters go, which turns ``~02abc`` into ``2abc``.
    With ``strip_version`` the whole ``~0<digit>`` prefix goes.
    """
    if strip_version:
        return F.regexp_replace(cipher, r"^~0\d", "")
    return F.ltrim(cipher, F.lit("~0"))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


def split_list(text: Column) -> Column:
    """Items of a comma-separated list, stripped, empty ones dropped."""
    items = F.transform(F.split(text, ","), stripped)
    return F.filter(items, lambda item: item != "")


def all_terms(query: Column, *texts: Column) -> Column:
    """Whether every word of the query occurs in one of the texts, whatever the case.

    A line break parts the texts; no word has one. The texts are the argument of the outer
    function, so they are put in lower case once a row.
    """
    together = F.lower(F.concat_ws("\n", *texts))
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda word: word != "")
    return F.forall(
        F.transform(F.array(together), lambda whole: F.forall(words, whole.contains)),
        lambda every: every,
    )
