"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one of the target text, one of the raw text.
A document's log weight is the sum of the log ratios of its n-grams. Gumbel noise is added to it,
and the k highest stay, which draws k documents without return in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm.common import (
    LOWER,
    bounded_batches,
    ends_of,
    fresh,
    large_texts,
    lots,
    split_words,
    translated,
)
from listweave.session import pinned

BUCKETS = 1 << 16
#: Bound on the labelled documents: they make the target model and set k. All documents make the
#: raw model.
LABELLED = 20_000
TEXT_BYTES = 2 << 20
SEED = 5
BINS = 1024
#: A bin with at most this many keys is sorted on the driver.
FEW_KEYS = 2_000
REPEATED = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of all texts, one text after the other, and how many each has.

    Tokens are runs of letters and digits and runs of other signs, in lower case. A token that
    repeats the one before it counts as a sign of its own, so repetition looks the same for all
    words.
    """
    spaced = pc.replace_substring_regex(
        translated(large_texts(texts), LOWER), r"([!-/:-@\[-`{-~]+)", r" \1 "
    )
    words, counts = split_words(spaced)
    if not len(words):
        return np.zeros(0, np.int64), counts
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    unique = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    code = coded.indices.to_numpy()
    token = unique[code]
    cuts = ends_of(counts)
    opens = np.zeros(len(token), bool)
    opens[cuts[:-1][counts > 0]] = True
    again = np.concatenate([[False], code[1:] == code[:-1]]) & ~opens
    token = np.where(again, REPEATED, token)
    pair = (np.concatenate([token[:1], token[:-1]]) * MIX) ^ token
    pair ^= pair >> np.uint64(29)
    # The first token of a text has no bigram; it stands for itself once more.
    pair = np.where(opens, token, pair * MIX)
    both = np.stack([token, pair], axis=1).reshape(-1)
    both ^= both >> np.uint64(32)
    return (both % np.uint64(buckets)).astype(np.int64), 2 * counts


def gram_counts(labelled: DataFrame, buckets: int) -> np.ndarray:
    """Counts of n-grams by bucket: of all rows, and of rows with ``quality`` 1.

    ``labelled`` has ``text`` and ``quality``. Every task adds up a table of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for whole in batches:
            for batch in lots(whole, 0, TEXT_BYTES):
                grams, counts = gram_buckets(batch.column(0), buckets)
                good = pc.fill_null(pc.equal(batch.column(1), 1), False)
                chosen = np.repeat(good.to_numpy(zero_copy_only=False), counts)
                total[0] += np.bincount(grams, minlength=buckets)
                total[1] += np.bincount(grams[chosen], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.record_batch(
            [pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])],
            names=["bucket", "raw", "target"],
        )

    summed = (
        bounded_batches(labelled)
        .select("text", "quality")
        .mapInArrow(count, "bucket bigint, raw bigint, target bigint")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
    )
    result = np.zeros((2, buckets), np.int64)
    for bucket, raw, target in summed.collect():
        result[:, bucket] = raw, target
    return result


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, each count raised by one."""
    raw, target = counts
    if not target.any():
        return np.zeros(len(raw))
    buckets = len(raw)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log(
        (raw + 1) / (raw.sum() + buckets)
    )


def with_log_weight(docs: DataFrame, keep: list[str], ratios: np.ndarray, name: str) -> DataFrame:
    """``keep`` columns with the log weight of ``text`` as ``name``, null if it has no words."""
    ratio = docs.sparkSession.sparkContext.broadcast(ratios)
    text = fresh(docs.select(*keep), "_text")
    work = bounded_batches(docs).select(*keep, F.col("text").alias(text))
    buckets = len(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in lots(whole, whole.num_columns - 1, TEXT_BYTES):
                grams, counts = gram_buckets(batch.column(batch.num_columns - 1), buckets)
                owner = np.repeat(np.arange(len(counts)), counts)
                sums = np.bincount(owner, ratio.value[grams], minlength=len(counts))
                weights = pa.array(sums, pa.float64(), mask=counts == 0)
                yield pa.record_batch([*batch.columns[:-1], weights], names=[*keep, name])

    schema = docs.select(*keep, F.lit(None).cast("double").alias(name)).schema
    return work.mapInArrow(weigh, schema)


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of the widest gap that has it.

    Zero, where both models explain a text alike, if one of the classes is missing.
    """
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    share_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    share_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    gaps = np.diff(w)
    score = np.where(gaps > 0, (share_bad - share_good)[1:-1], -np.inf)
    best = np.flatnonzero(score == score.max())
    at = best[np.argmax(gaps[best])]
    return float((w[at] + w[at + 1]) / 2)


def kth_highest(keys: DataFrame, k: int) -> float | None:
    """The k-th highest value of the stored one-column table ``keys`` without nulls.

    Counts per bin narrow the range down until few keys or one value are left, so the driver sees
    at most ``BINS`` counts and ``FEW_KEYS`` keys whatever the size. None if k is 0.
    """
    if k <= 0:
        return None
    keys = keys.toDF("key")
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        inside = keys.filter(F.col("key").between(low, high))
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        bins = inside.groupBy(
            F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")
        ).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high, size = row["low"], row["high"], row["n"]
                break
            above += row["n"]
        if size <= FEW_KEYS:
            few = keys.filter(F.col("key").between(low, high)).collect()
            return sorted((r["key"] for r in few), reverse=True)[k - above - 1]
    return high


def selection(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    name: str,
    buckets: int = BUCKETS,
    labelled: int = LABELLED,
    seed: int = SEED,
) -> DataFrame:
    """The ``keep`` columns of every row and a struct column ``name`` with ``log_weight``, ``key``
    (with noise) and ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); at most ``labelled`` labels, chosen
    by hash of the id, are used. k is the number of rows whose weight is above the threshold that
    tells the labelled rows apart best. Rows that tie with the last one that stays also stay. The
    noise is a hash of id and text, so reruns agree. Null and empty texts have a null weight and
    go. Labels without id or quality are ignored, repeated ones count once (good if any is).
    Without labelled good text nothing can be told and all rows with words stay.
    """
    sample = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(labelled)
    )
    sample = pinned(sample)
    id_name, text_name = fresh(docs, "_id"), fresh(docs, "_key")
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")
    ratios = log_ratios(gram_counts(marked, buckets))
    weight = fresh(docs, "_weight")
    keyed = docs.withColumns({id_name: F.col("doc_id"), text_name: F.xxhash64("text")})
    rows = pinned(with_log_weight(keyed, [*keep, id_name, text_name], ratios, weight))
    checked = (
        rows.filter(F.col(weight).isNotNull())
        .select(F.col(id_name).alias("doc_id"), F.col(weight).alias("w"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("w").alias("w"), F.first("quality").alias("quality"))
        .collect()
    )
    threshold = best_threshold(
        np.array([r["w"] for r in checked]), np.array([r["quality"] == 1 for r in checked], bool)
    )
    even = (F.pmod(F.xxhash64(id_name, text_name, F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    rows = rows.withColumn(text_name, F.col(weight) - F.log(-F.log(even)))
    k = rows.filter(F.col(weight) >= threshold).count()
    cut = kth_highest(rows.filter(F.col(weight).isNotNull()).select(text_name), k)
    kept = F.coalesce(F.col(text_name) >= F.lit(cut).cast("double"), F.lit(False))
    return rows.select(
        *keep,
        F.struct(
            F.col(weight).alias("log_weight"), F.col(text_name).alias("key"), kept.alias("kept")
        ).alias(name),
    )


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``log_weight``, ``key`` and ``kept`` of every row, as :func:`selection`.

    Repeated rows are kept or go together. Other columns are ignored whatever their names. Empty
    tables are fine on either side.
    """
    return selection(docs, labels, ["doc_id"], "found").select("doc_id", "found.*")


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`selection` keeps, with all their columns."""
    name = fresh(docs, "_found")
    found = selection(docs, labels, docs.columns, name)
    return found.filter(F.col(name)["kept"]).select(*docs.columns)
