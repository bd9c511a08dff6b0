"""Keyword selection and relevance for a table of queries.

The rules are those for one query: a term matches a text that contains it, in any case of letters.
Terms and words hold no blanks, so a text contains a term if one of its words does. Each distinct
word of the texts is held against the terms once, by a sequence of three letters that both
have; texts are only reached by words. Terms of one or two letters are looked up among the sequences
that a text has. No query is held against all texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listweave.operators.arrival import capped
from listweave.operators.spread import hot_keys, salted_join, stored_join
from listweave.session import pinned

GRAM = 3
BLANKS = r"\s+"


def _words(text):
    return F.explode(F.array_distinct(F.split(F.lower(F.col(text)), BLANKS)))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """Distinct ``(query, term)``; a query without terms has no rows."""
    terms = queries.select(F.col(query).alias("query"), _words(text).alias("term"))
    return terms.filter(F.col("term") != "")


def postings(rows: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """``(key, word, field)`` once for every word of a field; ``field`` is the field's number."""

    def words_of(name: str, number: int) -> DataFrame:
        found = rows.select(F.col(key).alias("key"), _words(name).alias("word"))
        return found.filter(F.col("word") != "").withColumn("field", F.lit(number))

    return reduce(DataFrame.unionByName, [words_of(c, i) for i, c in enumerate(fields)])


def _grams(words: DataFrame, word: str) -> DataFrame:
    """Rows with every ``gram`` of ``word``, repeats included; a shorter word has none."""
    long = words.filter(F.length(word) >= GRAM)
    starts = F.explode(F.sequence(F.lit(1), F.length(word) - GRAM + 1)).alias("_start")
    gram = F.substring(F.col(word), F.col("_start"), F.lit(GRAM))
    return long.select("*", starts).select(*words.columns, gram.alias("gram"))


def short_postings(rows: DataFrame, key: str, fields: dict[str, int], terms: DataFrame) -> DataFrame:
    """``(term, key, field)`` for stored ``terms`` of fewer letters than a sequence. Nearly every word
    has some of them, so they are read off the texts without a row for each word."""

    def start(size: int):
        return lambda gram: F.substring(gram, 1, size)

    def grams_of(name: str, number: int) -> DataFrame:
        words = F.array_join(F.array_distinct(F.split(F.lower(F.col(name)), BLANKS)), " ")
        most = F.lit(f"(?s)(?=(.{{1,{GRAM - 1}}})).")
        sequences = F.array_distinct(F.regexp_extract_all(words, most, 1))
        starts = [F.transform(sequences, start(size)) for size in range(1, GRAM - 1)]
        grams = F.array_distinct(F.concat(sequences, *starts))
        found = rows.select(F.col(key).alias("key"), F.explode(grams).alias("term"))
        return found.withColumn("field", F.lit(number))

    grams = reduce(DataFrame.unionByName, [grams_of(c, i) for i, c in enumerate(fields)])
    return stored_join(grams, terms, ["term"], "left_semi", ["key"]).select("term", "key", "field")


def words_of_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, word)`` for each distinct word that contains the term. Terms have at least three
    letters; one looks only for words with its rarest sequence of three. Sequences that no term has
    are not counted and not moved."""
    wanted = pinned(_grams(terms.select("term"), "term").distinct())
    have = _grams(words.select("word"), "word")
    counts = (
        have.join(wanted.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
    )
    # A term with a sequence that no word has is in no word.
    rarest = pinned(
        wanted.join(counts, "gram", "left")
        .groupBy("term")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("first"))
        .filter("first.n > 0")
        .select("term", F.col("first.gram").alias("gram"))
    )
    found = have.join(rarest, "gram").filter(F.col("word").contains(F.col("term")))
    return found.select("term", "word").distinct()


def _term_postings(rows: DataFrame, key: str, fields: dict[str, int], terms: DataFrame) -> DataFrame:
    """``(term, key, field)`` for all terms, once for each word that has the term."""
    terms = pinned(terms.select("term").distinct())
    long = F.length("term") >= GRAM
    of_words = pinned(postings(rows, key, fields))
    counts = pinned(of_words.groupBy("word").agg(F.count("*").alias("_n")))
    matched = pinned(words_of_terms(counts.select("word"), terms.filter(long)))
    # Frequent words own many postings; their terms are repeated for each part of them.
    joined = salted_join(of_words, matched, ["word"], "inner", ["key"], hot_keys(counts))
    found = joined.select("term", "key", "field")
    short = pinned(terms.filter(~long))
    if short.isEmpty():
        return found
    return found.unionByName(short_postings(rows, key, fields, short))


def all_terms_match(
    rows: DataFrame, key: str, fields: list[str], queries: DataFrame, query: str, text: str
) -> DataFrame:
    """``(query, key)`` for the rows in whose ``fields`` all terms of a query are found, each in any
    field. Keys and query ids are unique; a null key is a key. A query without terms matches
    nothing, as it asks for nothing.

    A query is first joined by its rarest term; the other terms only confirm what that one found.
    """
    terms = pinned(query_terms(queries, query, text))
    found = _term_postings(rows, key, dict.fromkeys(fields, 1), terms)
    found = pinned(found.select("term", "key").distinct())
    counts = found.groupBy("term").agg(F.count("*").alias("_n"))
    # A term that no row has leaves its queries without rows.
    sized = terms.join(counts, "term", "left")
    by_rarity = Window.partitionBy("query").orderBy("_n", "term")
    asked = pinned(
        sized.select(
            "query",
            "term",
            F.row_number().over(by_rarity).alias("nth"),
            F.min(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("query")).alias("least"),
            F.count("*").over(Window.partitionBy("query")).alias("n_terms"),
        ).filter("least > 0")
    )
    first = asked.filter("nth = 1").select("query", "term", "n_terms")
    hot = hot_keys(counts)
    candidates = pinned(
        salted_join(found, first, ["term"], "inner", ["key"], hot).select("query", "key", "n_terms")
    )
    others = asked.filter("nth > 1").select("query", "term")
    to_check = candidates.filter("n_terms > 1").join(others, "query")
    confirmed = (
        to_check.join(found.withColumnRenamed("key", "_key"),
                      (to_check.term == found.term) & to_check.key.eqNullSafe(F.col("_key")),
                      "left_semi")
        .groupBy("query", "key", "n_terms")
        .agg(F.count("*").alias("n"))
        .filter("n = n_terms - 1")
        .select("query", "key")
    )
    return candidates.filter("n_terms = 1").select("query", "key").unionByName(confirmed)


def most_relevant_for(
    rows: DataFrame,
    key: str,
    fields: dict[str, int],
    queries: DataFrame,
    query: str,
    text: str,
    ties: list,
    count: int,
) -> DataFrame:
    """``(query, key, score)`` of the ``count`` rows of highest score for each query. A term scores
    the weight of every field that contains it, by ``fields``; rows without any term are left out.
    ``ties`` order rows of equal score by expressions over ``key``."""
    terms = pinned(query_terms(queries, query, text))
    found = _term_postings(rows, key, fields, terms)
    weights = [
        F.max((F.col("field") == number).cast("int")) * weight
        for number, weight in enumerate(fields.values())
    ]
    points = reduce(Column.__add__, weights).alias("points")
    scored = pinned(found.groupBy("term", "key").agg(points))
    counts = scored.groupBy("term").agg(F.count("*").alias("_n"))
    pairs = salted_join(scored, terms, ["term"], "inner", ["key"], hot_keys(counts))
    totals = pairs.groupBy("query", "key").agg(F.sum("points").cast("bigint").alias("score"))
    names = [f"_tie{i}" for i in range(len(ties))]
    ordered = totals.select(
        "*", (-F.col("score")).alias("_order"), *[t.alias(n) for t, n in zip(ties, names)]
    )
    return capped(ordered, ["query"], ["_order", *names], count).select("query", "key", "score")
