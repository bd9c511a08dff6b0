"""Benchmark passages in documents, found with an FM-index per shard of text.

A shard is a stretch of rows of bounded size within a task. Words that no benchmark phrase has can
be in no occurrence: the index holds the remaining runs of words, each closed by a mark, and is
searched backwards for all phrases at once. Located occurrences are merged to spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm.common import (
    ALNUM,
    bounded_batches,
    ends_of,
    fresh,
    large_texts,
    lots,
    split_words,
    translated,
)
from listweave.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 16 << 20
#: Bound on the benchmark text of one broadcast; a larger benchmark is searched in several steps.
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "spans:array<struct<start:int,end:int>>>"
)
FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
#: Symbols of the index: 0 ends it, this one closes a run, words follow.
MARK = 1


@dataclass
class Phrases:
    """Distinct windows of some items: word numbers in rows, and the items of each window."""

    vocabulary: pa.Array
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    def plain(self) -> tuple:
        """The parts, for a broadcast that needs no class of this package to be read."""
        return self.vocabulary, self.rows, self.lengths, self.items

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(translated(large_texts(texts), ALNUM))


def phrases_of(item_ids: list[str | None], texts: list[str | None], window: int) -> Phrases:
    """Windows of the items. Items without words have none; an item without id is searched, but
    not named."""
    words, counts = words_in(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64) + MARK + 1
    cuts = ends_of(counts)
    found: dict[tuple[int, ...], set[str]] = {}
    for i, item in enumerate(item_ids):
        own = numbers[cuts[i] : cuts[i + 1]].tolist()
        for start in range(max(1, len(own) - window + 1) if own else 0):
            named = found.setdefault(tuple(own[start : start + window]), set())
            if item is not None:
                named.add(item)
    rows = np.zeros((len(found), window), np.int64)
    lengths = np.array([len(p) for p in found], np.int64)
    for i, phrase in enumerate(found):
        rows[i, : len(phrase)] = phrase
    return Phrases(coded.dictionary, rows, lengths, [sorted(v) for v in found.values()])


@dataclass
class Hits:
    """Of one shard: per row its number of words, hit words and items; spans of words by row."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[str]]
    spans: dict[int, list[tuple[int, int]]]


def hits_in(texts: pa.Array, phrases: Phrases) -> Hits:
    words, counts = words_in(texts)
    n = len(counts)
    hits = Hits(counts, np.zeros(n, np.int64), [[] for _ in range(n)], {})
    if not len(words) or not len(phrases.rows):
        return hits
    number = pc.index_in(words, value_set=phrases.vocabulary).cast(pa.int64())
    symbol = pc.fill_null(number, -1 - MARK).to_numpy() + MARK + 1
    cuts = ends_of(counts)
    # Runs of known words within a row.
    known = symbol > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    filled = cuts[:-1][counts > 0]
    begins[filled] = known[filled]
    run_start = np.flatnonzero(begins)
    if not len(run_start):
        return hits
    run_of = np.cumsum(begins) - 1
    run_length = np.bincount(run_of[known], minlength=len(run_start))
    long = run_length >= phrases.shortest
    kept = known & long[np.maximum(run_of, 0)]
    place = np.flatnonzero(kept)
    if not len(place):
        return hits
    # Every run is followed by a mark: the k-th kept run is moved by k.
    moved = np.arange(len(place)) + (np.cumsum(begins[place]) - 1)
    sequence = np.full(moved[-1] + 2, MARK, np.int64)
    sequence[moved] = symbol[place]
    word_at = np.full(len(sequence), -1, np.int64)
    word_at[moved] = place
    index = FMIndex(sequence)
    low, high = index.search(phrases.rows, phrases.lengths)
    live = np.flatnonzero(low < high)
    at, which = index.locate(low[live], high[live])
    start, phrase = word_at[at], live[which]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + phrases.lengths[phrase], -1)
    hit = np.cumsum(edge[:-1]) > 0
    row = np.searchsorted(cuts, start, side="right") - 1
    pairs = np.unique(np.stack([row, phrase]), axis=1)
    for r, p in pairs.T.tolist():
        hits.items[r] += phrases.items[p]
    for r in np.unique(row).tolist():
        own = hit[cuts[r] : cuts[r + 1]]
        hits.n_hit[r] = own.sum()
        turns = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        hits.spans[r] = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
        hits.items[r] = sorted(set(hits.items[r]))
    return hits


def merged(first: list[tuple[int, int]], second: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of both lists, overlapping and touching ones as one."""
    result: list[tuple[int, int]] = []
    for start, end in sorted([*first, *second]):
        if result and start <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((start, end))
    return result


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words from ``start`` to before ``end`` of each span, and what is
    between them."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.translate(ALNUM))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(data[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[tuple[list[str | None], list[str]]]:
    ids: list[str | None] = []
    texts: list[str] = []
    size = 0
    rows = bench.filter("text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text)
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def with_hits(
    docs: DataFrame,
    bench: DataFrame,
    keep: list[str],
    name: str,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = True,
    cut: bool = False,
) -> DataFrame:
    """The ``keep`` columns, ``text`` if wanted, and a struct column ``name`` with ``n_words``,
    ``n_hit``, ``items`` and ``spans`` (word numbers from, to before).

    A document word inside an occurrence of a window of ``window`` consecutive words of an item is
    hit; an item with fewer words is one window. Null and empty texts have no words. The benchmark
    is broadcast in blocks of at most ``block_bytes`` and an item more; each block is a step of the
    same job that adds to what the steps before it found. With ``cut`` the last step takes the
    spans out of the text.
    """
    text = "text" if "text" in keep else fresh(docs.select(*keep), "text")
    columns = [*keep] if "text" in keep else [*keep, text]
    bounded_batches(docs)
    work = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))
    work = work.withColumn(name, F.lit(None).cast(FOUND))
    schema = work.schema
    at = columns.index(text)

    def step(phrases, cutting: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in lots(whole, at, SHARD_BYTES):
                    earlier = batch.column(batch.num_columns - 1).to_pylist()
                    hits = hits_in(batch.column(at), Phrases(*phrases.value))
                    found = []
                    for r, old in enumerate(earlier):
                        items, spans = hits.items[r], hits.spans.get(r, [])
                        n_hit = int(hits.n_hit[r])
                        if old is not None and old["spans"]:
                            before = [(s["start"], s["end"]) for s in old["spans"]]
                            spans = merged(before, spans)
                            items = sorted({*old["items"], *items})
                            n_hit = sum(e - s for s, e in spans)
                        found.append(
                            {
                                "n_words": int(hits.n_words[r]),
                                "n_hit": n_hit,
                                "items": items,
                                "spans": [{"start": s, "end": e} for s, e in spans],
                            }
                        )
                    parts = [*batch.columns[:-1], pa.array(found, FOUND_ARROW)]
                    if cutting and any(x["spans"] for x in found):
                        texts = batch.column(at).to_pylist()
                        for r, x in enumerate(found):
                            if x["spans"]:
                                spans = [(s["start"], s["end"]) for s in x["spans"]]
                                texts[r] = without_spans(texts[r], spans)
                        parts[at] = pa.array(texts, pa.string())
                    yield pa.record_batch(parts, names=[*columns, name])

        return run

    context = docs.sparkSession.sparkContext
    blocks = _blocks(bench, block_bytes)
    now = next(blocks, ([], []))
    while now is not None:
        later = next(blocks, None)
        phrases = context.broadcast(phrases_of(*now, window).plain())
        work = work.mapInArrow(step(phrases, cut and later is None), schema)
        now = later
    return work if keep_text or text in keep else work.drop(text)


def decontamination_report(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of
    the item ids, sorted as strings and joined by commas; of the empty text if there are none) and
    ``contaminated``.

    Null or empty texts have no words and are clean. Repeated rows and null ids give a row each.
    Item ids that repeat count once, null item ids are not counted. Other columns are ignored
    whatever their names; empty tables are fine on either side.
    """
    found = with_hits(docs, bench, ["doc_id"], "found", window, keep_text=False)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with benchmark passages cut out of ``text``; all columns stay.

    ``n_chars``, if there is such a column, is counted anew where a text changed.
    """
    name = fresh(docs, "_found")
    result = with_hits(docs, bench, docs.columns, name, window, cut=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col(name)["n_hit"] > 0
        counted = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        result = result.withColumn("n_chars", counted)
    return result.select(*docs.columns)
