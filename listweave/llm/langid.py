"""Language identification with a small convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths run over a window of fixed length, each filter keeps
its maximum, and a softmax layer names the language. A text is cut into windows, all of it, and the
windows' probabilities are averaged by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listweave.llm.common import (
    LOWER,
    bounded_batches,
    ends_of,
    large_texts,
    lots,
    ranges,
    translated,
)
from listweave.session import pinned

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDED = 8
#: Bounds of the training sample: documents of each language, characters of a document.
PER_LANGUAGE = 500
SAMPLE_CHARS = 2_048
STEPS = 1_200
BATCH = 64
RATE = 0.01
SEED = 3
TEXT_BYTES = 4 << 20
WINDOWS_AT_ONCE = 64
UNKNOWN = "und"


@dataclass
class Network:
    """``embedding``: 256 x EMBEDDED. ``kernel``: (widest * EMBEDDED) x all filters, zero where a
    narrower filter does not reach. ``out`` and ``bias``: the softmax layer."""

    embedding: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _reach() -> np.ndarray:
    """Which kernel rows each filter has."""
    mask = np.zeros((max(WIDTHS) * EMBEDDED, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBEDDED, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def _patches(codes: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """Embedded bytes of every place and the ones after it: (windows, places, widest * EMBEDDED).
    """
    padded = np.pad(codes, ((0, 0), (0, max(WIDTHS) - 1)))
    x = embedding[padded]
    n, length = codes.shape
    view = np.lib.stride_tricks.as_strided(
        x,
        (n, length, max(WIDTHS) * EMBEDDED),
        (x.strides[0], x.strides[1], x.strides[2]),
        writeable=False,
    )
    return np.ascontiguousarray(view)


def probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """Probability of each class for windows of bytes, zero-padded at the end."""
    result = np.empty((len(codes), len(net.bias)), np.float64)
    for start in range(0, len(codes), WINDOWS_AT_ONCE):
        part = codes[start : start + WINDOWS_AT_ONCE]
        patches = _patches(part, net.embedding)
        found = patches.reshape(-1, patches.shape[2]) @ net.kernel
        top = found.reshape(len(part), part.shape[1], -1).max(axis=1) + net.shift
        result[start : start + WINDOWS_AT_ONCE] = _softmax(np.maximum(top, 0) @ net.out + net.bias)
    return result


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: np.ndarray, classes: int, seed: int = SEED) -> Network:
    """A network fitted by Adam to random windows of random length of the texts.

    Every class is drawn equally often.
    """
    rng = np.random.default_rng(seed)
    filters = len(WIDTHS) * FILTERS
    reach = _reach()
    net = Network(
        (rng.standard_normal((256, EMBEDDED)) * 0.3).astype(np.float32),
        (rng.standard_normal(reach.shape) * 0.3).astype(np.float32) * reach,
        np.zeros(filters, np.float32),
        (rng.standard_normal((filters, classes)) * 0.3).astype(np.float32),
        np.zeros(classes, np.float32),
    )
    names = ("embedding", "kernel", "shift", "out", "bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    members = [np.flatnonzero(labels == c) for c in range(classes)]
    widest = max(WIDTHS)
    for step in range(1, STEPS + 1):
        target = rng.integers(0, classes, BATCH)
        codes = np.zeros((BATCH, WINDOW), np.uint8)
        for row, c in enumerate(target):
            text = texts[members[c][rng.integers(len(members[c]))]]
            size = int(rng.integers(16, WINDOW + 1))
            start = int(rng.integers(0, max(1, len(text) - size + 1)))
            piece = np.frombuffer(text[start : start + size], np.uint8)
            codes[row, : len(piece)] = piece
        patches = _patches(codes, net.embedding)
        found = (patches.reshape(-1, patches.shape[2]) @ net.kernel).reshape(BATCH, WINDOW, filters)
        place = found.argmax(axis=1)
        rows = np.arange(BATCH)[:, None]
        top = found[rows, place, np.arange(filters)[None]] + net.shift
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ net.out + net.bias)
        error[np.arange(BATCH), target] -= 1
        error /= BATCH
        back = (error @ net.out.T) * (top > 0)
        chosen = patches[rows, place]
        kernel = np.einsum("nfk,nf->kf", chosen, back) * reach
        spread = np.einsum("nf,kf->nfk", back, net.kernel).reshape(-1, EMBEDDED)
        padded = np.pad(codes, ((0, 0), (0, widest - 1)))
        read = padded[rows[:, :, None], place[:, :, None] + np.arange(widest)].reshape(-1)
        embedding = np.zeros_like(net.embedding)
        np.add.at(embedding, read, spread)
        gradients = {
            "embedding": embedding,
            "kernel": kernel,
            "shift": back.sum(axis=0),
            "out": hidden.T @ error,
            "bias": error.sum(axis=0),
        }
        for n in names:
            g = gradients[n].astype(np.float32)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            setattr(net, n, (getattr(net, n) - RATE * move).astype(np.float32))
    return net


def training_sample(docs: DataFrame, learned) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, text pieces and their language numbers, from rows where ``learned`` holds.

    All languages, with ``PER_LANGUAGE`` documents each by hash of the id; of a longer document a
    stretch of ``SAMPLE_CHARS`` at a hashed place.
    """
    usable = docs.filter("text is not null and lang is not null").filter(learned)
    scale = 1 << 30
    # A thin sample by hash first, so that the ranking below sees a bounded number of rows.
    rates = pinned(
        usable.groupBy("lang").agg(
            F.least(F.lit(scale), F.floor(F.lit(3 * PER_LANGUAGE * scale) / F.count("*")) + 1).alias(
                "rate"
            )
        )
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(scale))
    most = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    thin = usable.join(rates, "lang").filter(draw < F.col("rate")).select(
        "lang",
        draw.alias("draw"),
        F.expr("text").substr(
            (F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), most) + 1).cast("int"),
            F.lit(SAMPLE_CHARS),
        ).alias("piece"),
    )
    order = Window.partitionBy("lang").orderBy("draw", "piece")
    rows = (
        thin.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= PER_LANGUAGE)
        .orderBy("lang", "n")
        .collect()
    )
    names = sorted({r["lang"] for r in rows if r["piece"]})
    number = {name: i for i, name in enumerate(names)}
    rows = [r for r in rows if r["piece"]]
    texts = [r["piece"].encode().translate(LOWER) for r in rows]
    return names, texts, np.array([number[r["lang"]] for r in rows], np.int64)


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, zero-padded; the text of each and its number of bytes."""
    sizes = pc.binary_length(texts).to_numpy()
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = ranges(np.zeros(len(sizes), np.int64), counts)
    length = np.minimum(WINDOW, sizes[owner] - number * WINDOW)
    start = ends_of(sizes)[:-1][owner] + number * WINDOW
    codes = np.zeros((len(owner), WINDOW), np.uint8)
    inside = np.arange(WINDOW)[None] < length[:, None]
    codes[inside] = data[ranges(start, length)]
    return codes, owner, length


def predicted(docs: DataFrame, held_out=None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row of ``docs``.

    The network learns from ``text`` and non-null ``lang`` of a bounded sample of the rows for which
    ``held_out`` (by default: the crc32 of ``doc_id`` as text leaves 1 when divided by 3) is false;
    rows with null ids are not learned from and not held out. Only the text is used to predict. The
    score is the mean probability of the named language over the windows of the whole text, weighed
    by length; ties go to the first language in order. Texts that are null or have no letter are
    ``und`` with score 0, and so are all if there is nothing to learn from. Repeated rows get equal
    results. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    languages, texts, labels = training_sample(docs.select("doc_id", "text", "lang"), ~held_out)
    net = train(texts, labels, len(languages)) if languages else None
    parts = None if net is None else (
        net.embedding, net.kernel, net.shift, net.out, net.bias
    )
    model = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in lots(whole, 2, TEXT_BYTES):
                texts = large_texts(batch.column(2))
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                names = np.full(len(batch), UNKNOWN, object)
                score = np.zeros(len(batch))
                if model.value is not None and lettered.any():
                    sums = np.zeros((len(batch), len(languages)))
                    codes, owner, length = windows_of(translated(texts, LOWER))
                    found = probabilities(Network(*model.value), codes) * length[:, None]
                    np.add.at(sums, owner, found)
                    sums /= np.maximum(pc.binary_length(texts).to_numpy(), 1)[:, None]
                    best = sums.argmax(axis=1)
                    names = np.where(lettered, np.array(languages, object)[best], UNKNOWN)
                    score = np.where(lettered, sums[np.arange(len(batch)), best], 0.0)
                yield pa.record_batch(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(names.tolist(), pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
