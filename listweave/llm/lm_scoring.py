"""Scores of texts: a byte model by context-tree weighting, and a word model as a base.

Every task cuts its rows into blocks of bounded size and writes their texts to the shared folder. A
block's distinct words and byte sequences with their training counts are all that is shuffled: they
are added up over the corpus, the model gives each a value, and the values go back to the blocks
that asked for them, where the texts are read once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm import ctw
from listweave.llm.common import (
    LOWER,
    bounded_batches,
    ends_of,
    file_system,
    large_texts,
    lots,
    split_words,
    translated,
)
from listweave.session import pinned, run_folder

BLOCK_BYTES = 32 << 20
#: Grams of a lot take eight times its bytes in each of several arrays.
TEXT_BYTES = 1 << 20
LOTS_AT_ONCE = 16
LOOKUPS_AT_ONCE = 1 << 18
#: Depth at which the trees are divided among tasks; what is above has a fixed number of nodes.
TOP = 2
#: Kinds of rows: a word, a gram, and one row per block with the path of its texts as the word.
WORD, GRAM, TEXT = 0, 1, 2
NEEDED = "block bigint, kind int, word binary, gram bigint, n bigint"


def grams_of(texts: pa.Array, depth: int = ctw.DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All byte sequences that end at a byte of a text or at its end, and how many each text has."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    data = texts.buffers()[2]
    source = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    wide = sizes + depth + 1
    padded = np.full(wide.sum(), ctw.EDGE, np.uint8)
    before = ends_of(wide)[:-1]
    inner = np.zeros(len(padded) + 1, np.int8)
    np.add.at(inner, before + depth, 1)
    np.add.at(inner, before + depth + sizes, -1)
    inner = np.cumsum(inner[:-1], dtype=np.int8).astype(bool)
    padded[inner] = source
    # Sequences of doubled length are put together from two of the last length.
    doubled = padded.astype(np.int64)
    keys, held, width = np.zeros(max(0, len(padded) - depth), np.int64), 0, 1
    while held <= depth:
        if (depth + 1) & width:
            keys = (keys << 8 * width) | doubled[held : held + len(keys)]
            held += width
        if held <= depth:
            doubled = (doubled[:-width] << 8 * width) | doubled[width:]
        width *= 2
    # The gram that starts at i ends at i + depth: every text has one per byte and one at its end.
    skipped = np.zeros(len(padded) + 1, np.int8)
    np.add.at(skipped, before, 1)
    np.add.at(skipped, before + sizes + 1, -1)
    starts = np.cumsum(skipped[: len(keys)], dtype=np.int8).astype(bool)
    return keys[starts], sizes + 1


def looked_up(sequences: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of ``sequences``, all of them among the sorted ``keys``.

    Lots of them are sorted first, so that they go through the keys from one end to the other.
    """
    found = np.empty(len(sequences), values.dtype)
    for start in range(0, len(sequences), LOOKUPS_AT_ONCE):
        part = sequences[start : start + LOOKUPS_AT_ONCE]
        order = np.argsort(part)
        found[start + order] = values[np.searchsorted(keys, part[order])]
    return found


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts), minlength=len(unique)).astype(np.int64)


class BlockNeeds:
    """Distinct words and grams of a block with their counts in its training rows."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.words: list[pa.Array] = []
        self.word_counts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.texts = 0
        self.bytes = 0

    def add(self, texts: pa.Array, learned: np.ndarray) -> None:
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0
        self.texts += int(learned.sum())
        texts = translated(texts, LOWER)
        own, per_text = split_words(texts)
        coded = own.dictionary_encode()
        self.words.append(coded.dictionary)
        self.word_counts.append(
            np.bincount(
                coded.indices.to_numpy(),
                np.repeat(learned, per_text),
                minlength=len(coded.dictionary),
            )
        )
        grams, per_text = grams_of(texts, self.depth)
        marked, n = np.unique((grams << 1) | np.repeat(learned, per_text), return_counts=True)
        self.keys.append(marked >> 1)
        self.counts.append(n * (marked & 1))
        if len(self.keys) > LOTS_AT_ONCE:
            self._merge()

    def _merge(self) -> None:
        keys, counts = _merged(self.keys, self.counts)
        self.keys, self.counts = [keys], [counts]
        coded = pa.concat_arrays(self.words).dictionary_encode()
        summed = np.bincount(
            coded.indices.to_numpy(),
            np.concatenate(self.word_counts),
            minlength=len(coded.dictionary),
        )
        self.words, self.word_counts = [coded.dictionary], [summed]

    def rows(self, block: int, path: str) -> pa.RecordBatch:
        self._merge()
        words, grams = self.words[0].cast(pa.large_binary()), self.keys[0]
        numbers = (len(words), len(grams), 1)
        no_word = pa.nulls(len(grams), pa.large_binary())
        named = pa.concat_arrays([words, no_word, pa.array([path.encode()], pa.large_binary())])
        return pa.record_batch(
            {
                "block": pa.array(np.full(sum(numbers), block, np.int64)),
                "kind": pa.array(np.repeat([WORD, GRAM, TEXT], numbers).astype(np.int32)),
                "word": named.cast(pa.binary()),
                "gram": pa.concat_arrays(
                    [pa.nulls(len(words), pa.int64()), pa.array(grams), pa.nulls(1, pa.int64())]
                ),
                "n": pa.array(
                    np.concatenate(
                        [self.word_counts[0], self.counts[0], [self.texts]]
                    ).astype(np.int64)
                ),
            }
        )


def stored_needs(rows: DataFrame, folder: str, depth: int) -> DataFrame:
    """Writes the texts of ``rows`` in blocks and returns the stored table of what they need.

    ``rows`` has ``doc_id``, ``held_out``, ``learned`` and ``text``. A block counts once its rows
    are in the table: a task that is run again writes other files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        part = TaskContext.get().partitionId()
        block, needs = part << 32, None
        for whole in batches:
            for batch in lots(whole, 3, TEXT_BYTES):
                texts = large_texts(batch.column(3))
                kept = pa.record_batch(
                    [batch.column(0), batch.column(1), texts], names=["doc_id", "held_out", "text"]
                )
                if needs is None:
                    needs = BlockNeeds(depth)
                    name = f"block-{part:06d}-{uuid.uuid4().hex}.arrow"
                    system.create_dir(place, recursive=True)
                    sink = system.open_output_stream(f"{place}/{name}")
                    options = ipc.IpcWriteOptions(compression="zstd")
                    writer = ipc.new_stream(sink, kept.schema, options=options)
                writer.write_batch(kept)
                needs.add(texts, batch.column(2).to_numpy(zero_copy_only=False))
                if needs.bytes >= BLOCK_BYTES:
                    writer.close()
                    sink.close()
                    yield needs.rows(block, f"{folder}/{name}")
                    block, needs = block + 1, None
        if needs is not None:
            writer.close()
            sink.close()
            yield needs.rows(block, f"{folder}/{name}")

    return pinned(rows.select("doc_id", "held_out", "learned", "text").mapInArrow(run, NEEDED))


def _sorted_grams(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    held = [[b.column(n).to_numpy() for n in ("gram", "n")] for b in batches]
    if not held:
        return []
    grams, n = (np.concatenate([h[i] for h in held]) for i in range(2))
    order = np.argsort(grams)
    return [grams[order], n[order]]


def gram_model(grams: DataFrame, depth: int) -> DataFrame:
    """``(gram, value)``: log10 probability of every gram of ``grams`` (``gram``, ``n``).

    Tasks hold whole subtrees below contexts of ``TOP`` bytes. What is above has at most 256 x 255
    nodes whatever the input; it comes to the driver and goes back as a broadcast.
    """
    top_bits = ctw.BITS * TOP
    by_context = grams.withColumn(
        "top", F.shiftright("gram", ctw.BITS).bitwiseAND((1 << top_bits) - 1)
    ).repartition("top")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _sorted_grams(batches)
        if not held:
            return
        seen = held[1] > 0
        tree = ctw.subtrees(held[0][seen], held[1][seen].astype(np.float64), TOP, depth)
        values = (tree.keys, tree.zeros, tree.ones, tree.log_weighted)
        yield pa.record_batch(
            [pa.array(v) for v in values], names=["key", "zeros", "ones", "log_weighted"]
        )

    mask = (1 << (ctw.BITS * TOP)) - 1
    above = (
        by_context.mapInArrow(roots, "key bigint, zeros double, ones double, log_weighted double")
        .groupBy(F.col("key").bitwiseAND(mask).alias("key"))
        .agg(F.sum("zeros"), F.sum("ones"), F.sum("log_weighted"))
        .collect()
    )
    rows = np.array(sorted(tuple(r) for r in above), np.float64).reshape(-1, 4)
    keys, zeros, ones, below = rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 2], rows[:, 3]
    levels = []
    for upper in (1, 0):
        block = ctw.log_block(zeros, ones)
        log_w = ctw.weighted(block, below)
        own = np.exp(block - np.log(2) - log_w)
        levels.append((keys, own, (ones + 0.5) / (zeros + ones + 1)))
        if upper:
            keys, place = np.unique(keys & (ctw.NODES - 1), return_inverse=True)
            zeros, ones, below = (
                np.bincount(place, v, minlength=len(keys)) for v in (zeros, ones, log_w)
            )
    high = grams.sparkSession.sparkContext.broadcast(levels)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _sorted_grams(batches)
        if not held:
            return
        seen = held[1] > 0
        tree = ctw.subtrees(held[0][seen], held[1][seen].astype(np.float64), TOP, depth)
        tree.levels[1], tree.levels[0] = (ctw.Level(*level) for level in high.value)
        found = ctw.log10_probabilities(held[0], tree.levels)
        yield pa.record_batch([pa.array(held[0]), pa.array(found)], names=["gram", "value"])

    return by_context.mapInArrow(values, "gram bigint, value double")


def scored(docs: DataFrame, held_out=None, depth: int = ctw.DEPTH) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``) under models of the rows not held out.

    Texts are lower-cased in A-Z. Columns: ``doc_id``, ``held_out`` (by default: the crc32 of the id
    as text leaves 2 when divided by 7), ``n_tokens`` (words and one end), ``n_known`` (tokens the
    training rows have), ``train_tokens``, ``base_score`` (log10 with each word's count raised by
    one), ``score`` (log10 probability of the text and its end under the byte model) and
    ``bits_per_byte``. Rows with a null id are neither held out nor learned from. Null and empty
    texts are an end alone. Repeated rows are learned from as often as they come. Other columns are
    ignored whatever their names. An empty table gives no rows. Contexts have ``depth`` bytes, from 2
    to 6; deeper models are better and move more.
    """
    if not TOP <= depth <= ctw.MOST_DEPTH:
        raise ValueError(f"contexts have {TOP} to {ctw.MOST_DEPTH} bytes")
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(~held_out, F.lit(False)).alias("learned"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    needs = stored_needs(rows, run_folder(spark, "lm-blocks"), depth)
    words = pinned(
        needs.filter(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").cast("double").alias("value"))
    )
    total = words.agg(
        F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("n"),
        F.count_if(F.col("value") > 0).alias("distinct"),
    ).first()
    ends = needs.filter(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train = total["n"] + ends
    divisor = np.log10(n_train + total["distinct"] + (ends > 0) + 1)
    grams = pinned(needs.filter(F.col("kind") == GRAM).groupBy("gram").agg(F.sum("n").alias("n")))
    model = pinned(gram_model(grams, depth))
    word_values = (
        needs.filter(F.col("kind") == WORD)
        .select("block", "kind", "word")
        .join(words, "word")
        .select("block", "kind", "word", F.lit(None).cast("bigint").alias("gram"), "value")
    )
    gram_values = (
        needs.filter(F.col("kind") == GRAM)
        .select("block", "kind", "gram")
        .join(model, "gram")
        .select("block", "kind", F.lit(None).cast("binary").alias("word"), "gram", "value")
    )
    paths = needs.filter(F.col("kind") == TEXT).select(
        "block", "kind", "word", "gram", F.lit(0.0).alias("value")
    )

    def score(values: pa.Table) -> pa.Table:
        kinds = values["kind"]
        known = values.filter(pc.equal(kinds, WORD))
        vocabulary = known["word"].combine_chunks().cast(pa.large_binary())
        word_count = known["value"].to_numpy()
        sequences = values.filter(pc.equal(kinds, GRAM))
        keys = sequences["gram"].to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], sequences["value"].to_numpy()[order]
        path = values.filter(pc.equal(kinds, TEXT))["word"][0].as_py().decode()
        system, place = file_system(path)
        read: list[tuple] = []
        with system.open_input_stream(place) as source:
            for batch in ipc.open_stream(source):
                own = translated(large_texts(batch.column("text")), LOWER)
                found, per_text = split_words(own)
                found_grams, per_gram = grams_of(own, depth)
                log = looked_up(found_grams, keys, logs)
                total = np.add.reduceat(log, ends_of(per_gram)[:-1])
                ids = batch.column("doc_id"), batch.column("held_out")
                coded = found.cast(pa.large_binary()).dictionary_encode()
                read.append((ids, coded.dictionary, coded.indices, per_text, per_gram, total))
        # The words of the whole block are looked up at once, as each call hashes the vocabulary.
        asked = pa.concat_arrays([r[1] for r in read])
        places = pc.index_in(asked, value_set=vocabulary).to_numpy()
        counts = word_count[places] if len(asked) else np.zeros(0)
        before = ends_of(np.array([len(r[1]) for r in read]))
        parts: list[pa.RecordBatch] = []
        for first, (ids, _, indices, per_text, per_gram, total) in zip(before, read, strict=False):
            n = len(per_text)
            count = counts[first + indices.to_numpy()] if len(indices) else np.zeros(0)
            owner = np.repeat(np.arange(n), per_text)
            base = np.bincount(owner, np.log10(count + 1) - divisor, minlength=n)
            seen = np.bincount(owner, count > 0, minlength=n).astype(np.int64)
            parts.append(
                pa.record_batch(
                    {
                        "doc_id": ids[0],
                        "held_out": ids[1],
                        "n_tokens": pa.array(per_text.astype(np.int64) + 1),
                        "n_known": pa.array(seen + int(ends > 0)),
                        "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                        "base_score": pa.array(base + np.log10(ends + 1) - divisor),
                        "score": pa.array(total),
                        "bits_per_byte": pa.array(-total / np.log10(2) / per_gram),
                    }
                )
            )
        return pa.Table.from_batches(parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        word_values.unionByName(gram_values)
        .unionByName(paths)
        .groupBy("block")
        .applyInArrow(
            score,
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
            "train_tokens bigint, base_score double, score double, bits_per_byte double",
        )
    )
