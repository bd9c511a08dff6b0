"""The best documents for each of a set of texts, found by branch and bound over trees of documents.

Of a document only the terms that some item asks for matter: its restricted vector. A task orders
these vectors by falling document frequency of their terms, so that documents with the same
frequent terms share a path of a trie (an FP-tree). A node knows the highest term frequency of each
term and the lowest length factor of the documents below it, which bounds their scores for any item.
Each item goes depth first into the most promising branch and leaves out every branch whose bound
is lower than the last of the best documents found so far.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listweave.llm.common import (
    ALNUM,
    bounded_batches,
    ends_of,
    large_texts,
    lots,
    split_words,
    translated,
    with_row_id,
)
from listweave.session import pinned, run_folder

#: Bytes of item texts that are searched, and broadcast, at once; a longer text goes alone.
ITEM_BYTES = 1 << 20
#: Documents of a tree, fewer if the table of their terms would get more cells than this.
TREE_ROWS = 2_048
TREE_CELLS = 8 << 20
#: A branch of so few documents is scored at once.
LEAF_ROWS = 8
TEXT_BYTES = 4 << 20

VECTORS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
VECTORS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("terms", pa.list_(pa.int32())),
        ("tfs", pa.list_(pa.int32())),
    ]
)
FOUND = "item bigint, score bigint, doc_id bigint"


def terms_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased, and how
    many each text has."""
    return split_words(translated(large_texts(texts), ALNUM))


def restricted_vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id``, number of terms, and numbers and frequencies of the terms in ``vocabulary``, of
    all documents with a term."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in lots(whole, 1, TEXT_BYTES):
                terms, counts = terms_in(batch.column(1))
                found = pc.index_in(terms, value_set=words.value)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                number = pc.fill_null(found, 0).to_numpy()[known].astype(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)[known]
                pair, tf = np.unique(owner * len(words.value) + number, return_counts=True)
                doc, term = np.divmod(pair, max(1, len(words.value)))
                some = np.flatnonzero(counts > 0)
                ends = np.searchsorted(doc, some, side="right")
                # Documents without a term have no pairs, so all pairs lie within these ends.
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(some)),
                        pa.array(counts[some], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    ],
                    schema=VECTORS_ARROW,
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, VECTORS)


@dataclass
class Tree:
    """Documents in order of their paths and the branches over them. ``tf`` and ``m`` hold rows of
    documents; ``most`` and ``least`` the same of nodes: the highest and the lowest below."""

    ids: pa.Array
    tf: np.ndarray
    m: np.ndarray
    starts: list[int]
    ends: list[int]
    children: list[list[int]]
    most: np.ndarray
    least: np.ndarray
    column: dict[int, int]


def shared_path(first: np.ndarray, second: np.ndarray) -> int:
    shorter = min(len(first), len(second))
    differ = np.flatnonzero(first[:shorter] != second[:shorter])
    return int(differ[0]) if len(differ) else shorter


def grown(ids: pa.Array, m: np.ndarray, counts, ranks: np.ndarray, tfs: np.ndarray) -> Tree:
    """The tree of documents with ``counts`` terms each, given by rank of frequency, and with their
    term frequencies, one document after the other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort([ranks, owner])
    ranks, tfs = ranks[order], tfs[order]
    cuts = ends_of(counts)
    paths = [ranks[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [p.astype(">u4").tobytes() for p in paths]
    turn = sorted(range(len(paths)), key=keys.__getitem__)
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    terms, columns = np.unique(ranks, return_inverse=True)
    tf = np.zeros((len(turn), len(terms)), np.int32)
    tf[place[owner], columns] = tfs
    shared = np.array(
        [shared_path(paths[a], paths[b]) for a, b in zip(turn, turn[1:], strict=False)], np.int64
    )
    starts, ends, children = [0], [len(turn)], [[]]
    at = 0
    while at < len(starts):
        start, end = starts[at], ends[at]
        if end - start > LEAF_ROWS:
            within = shared[start : end - 1]
            splits = start + 1 + np.flatnonzero(within == within.min())
            edges = [start, *splits.tolist(), end]
            # Short neighbours need no branches of their own.
            for a, b in zip(edges, edges[1:], strict=False):
                last = children[at][-1] if children[at] else None
                if last is not None and b - starts[last] <= LEAF_ROWS:
                    ends[last] = b
                else:
                    children[at].append(len(starts))
                    starts.append(a)
                    ends.append(b)
                    children.append([])
            if len(children[at]) == 1:
                children[at] = []
                del starts[-1], ends[-1], children[-1]
        at += 1
    m = m[turn]
    most = np.zeros((len(starts), len(terms)), np.int32)
    least = np.zeros(len(starts), np.int64)
    for node in range(len(starts) - 1, -1, -1):
        below = children[node]
        if below:
            most[node] = most[below].max(axis=0)
            least[node] = least[below].min()
        else:
            most[node] = tf[starts[node] : ends[node]].max(axis=0)
            least[node] = m[starts[node] : ends[node]].min()
    column = {int(r): i for i, r in enumerate(terms)}
    return Tree(ids.take(pa.array(turn)), tf, m, starts, ends, children, most, least, column)


def weighed(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of term frequencies, whose ``m`` are given, for the terms with these weights;
    higher frequencies and lower ``m`` score higher."""
    wide = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * wide) // (1000 * wide + 12 * m[:, None]))).sum(axis=1)


class Ranking:
    """The best documents of an item so far, best first; equal scores by id, no id last."""

    def __init__(self, keep: int):
        self.keep = keep
        self.best: list[tuple[int, bool, int]] = []

    @property
    def least(self) -> int:
        """The lowest score that can still get in."""
        return -self.best[-1][0] if len(self.best) == self.keep else 1

    def add(self, score: np.ndarray, ids: list[int | None]) -> None:
        new = [(-s, i is None, i or 0) for s, i in zip(score.tolist(), ids, strict=True)]
        self.best = sorted([*self.best, *new])[: self.keep]


def search(tree: Tree, ranks: np.ndarray, weights: np.ndarray, ranking: Ranking) -> None:
    """Depth first, the branch of the highest bound first; adds to ``ranking``."""
    there = [i for i, r in enumerate(ranks.tolist()) if r in tree.column]
    if not there:
        return
    columns = np.array([tree.column[int(ranks[i])] for i in there])
    weights = weights[there]
    most, tf = tree.most[:, columns], tree.tf[:, columns]
    stack = [(int(weighed(weights, most[:1], tree.least[:1])[0]), 0)]
    while stack:
        bound, node = stack.pop()
        if bound < ranking.least:
            continue
        below = tree.children[node]
        if below:
            bounds = weighed(weights, most[below], tree.least[below])
            good = np.flatnonzero(bounds >= ranking.least)
            order = good[np.argsort(bounds[good], kind="stable")]
            stack += [(int(bounds[i]), below[i]) for i in order]
        else:
            start, end = tree.starts[node], tree.ends[node]
            score = weighed(weights, tf[start:end], tree.m[start:end])
            good = np.flatnonzero(score >= ranking.least)
            if len(good):
                ranking.add(score[good], tree.ids.take(pa.array(good + start)).to_pylist())


@dataclass
class Items:
    """Some items: for each its number and the terms it asks for, by rank, with weights."""

    numbers: list[int]
    ranks: list[np.ndarray]
    weights: list[np.ndarray]


def trees(
    batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, corpus: tuple[int, int]
) -> Iterator[Tree]:
    """Trees over the rows of the task, each of bounded size. Rows without a wanted term have no
    score and no place."""
    documents, terms = corpus
    held: list[tuple] = []
    rows = 0
    distinct: set[int] = set()

    def tree() -> Tree:
        ids = pa.concat_arrays([h[0] for h in held])
        n, counts, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        # 25 * n * documents may pass 64 bits.
        m = np.array([75 + 25 * x * documents // terms for x in n.tolist()], np.int64)
        return grown(ids, m, counts, rank_of[term], tf)

    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            counts = pc.list_value_length(part.column(2)).to_numpy()
            term = part.column(2).flatten().to_numpy()
            more = distinct.union(np.unique(term).tolist())
            if held and (rows + len(part) > TREE_ROWS or (rows + len(part)) * len(more) > TREE_CELLS):
                yield tree()
                held, rows, more = [], 0, set(np.unique(term).tolist())
            distinct = more
            tf = part.column(3).flatten().to_numpy()
            held.append((part.column(0), part.column(1).to_numpy(), counts, term, tf))
            rows += len(part)
    if held:
        yield tree()


def found_in_tasks(
    vectors: DataFrame, items: Items, rank_of: np.ndarray, corpus: tuple[int, int], keep: int
) -> DataFrame:
    """The best documents of each task for each item."""
    sent = vectors.sparkSession.sparkContext.broadcast(
        (items.numbers, items.ranks, items.weights, rank_of)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ranks, weights, rank_of = sent.value
        rankings = [Ranking(keep) for _ in numbers]
        for tree in trees(batches, rank_of, corpus):
            for ranking, own_ranks, own_weights in zip(rankings, ranks, weights, strict=True):
                search(tree, own_ranks, own_weights, ranking)
        for number, ranking in zip(numbers, rankings, strict=True):
            if ranking.best:
                yield pa.record_batch(
                    [
                        pa.array([number] * len(ranking.best), pa.int64()),
                        pa.array([-s for s, _, _ in ranking.best], pa.int64()),
                        pa.array([None if none else i for _, none, i in ranking.best], pa.int64()),
                    ],
                    names=["item", "score", "doc_id"],
                )

    return vectors.mapInArrow(run, FOUND)


def ranked(docs: DataFrame, bench: DataFrame, keep: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``keep`` documents with the highest score above 0 for each row of ``bench``:
    ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; equal scores by ``doc_id``.

    Terms, weights and scores are those of the contract in integer arithmetic; corpus counts are
    those of all documents. Null and empty texts have no terms: such a document is not counted and
    such an item finds nothing. Repeated documents are ranked one by one, a document without id
    after others of its score. Repeated items are ranked each on their own; an item without id has
    a null ``item_id``. Empty tables give no rows; other columns are ignored.

    Items go in blocks of about ``item_bytes``; each block reads the documents once and is broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    items, row = with_row_id(bench.filter("text is not null").select("item_id", "text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    names = spark.createDataFrame([], bench.select("item_id").schema).schema["item_id"].dataType
    schema = f"item_id {names.simpleString()}, rank int, doc_id bigint, score bigint"
    if not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // item_bytes)
    folder = run_folder(spark, "ranked")
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64(row), F.lit(blocks)) == block)
        lines = some.select(row, "text").collect()
        terms, counts = terms_in(pa.array([x["text"] for x in lines], pa.string()))
        coded = terms.dictionary_encode()
        numbers = coded.indices.to_numpy()
        vectors = pinned(restricted_vectors(docs, coded.dictionary))
        documents, total = vectors.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(coded.dictionary), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = n
        # Rank 0 is the most frequent term; the order of terms of one frequency is that of numbers.
        rank_of = np.empty(len(df), np.int64)
        rank_of[np.lexsort([np.arange(len(df)), -df])] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df]
        cuts = ends_of(counts)
        wanted = Items([], [], [])
        for i, line in enumerate(lines):
            asked = Counter(numbers[cuts[i] : cuts[i + 1]].tolist())
            wanted.numbers.append(line[0])
            wanted.ranks.append(rank_of[list(asked)] if asked else np.zeros(0, np.int64))
            wanted.weights.append(np.array([weight[t] * c for t, c in asked.items()], np.int64))
        found = found_in_tasks(vectors, wanted, rank_of, (documents, total or 1), keep)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
        named = some.select(F.col(row).alias("item"), "item_id")
        best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score").write.parquet(
            f"{folder}/block={block}"
        )
    return spark.read.schema(schema).parquet(*[f"{folder}/block={b}" for b in range(blocks)])
