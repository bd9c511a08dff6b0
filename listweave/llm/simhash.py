"""Near-duplicate texts by SimHash fingerprints, compared in tiles.

Fingerprints are cut into parts, and the numbers of bits set in the parts name the cell of a
fingerprint. Two fingerprints within the radius lie in cells whose counts differ by at most the
radius in sum, so all other pairs of cells are skipped. Cells are stored as tiles of bounded size,
and two tiles are compared whole with exclusive-or and bit counts. The comparison is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

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
    with_row_id,
)
from listweave.llm.components import LINKS, components, star_batches
from listweave.session import pinned

SEED = 42
PARTS = 4
PART_BITS = 64 // PARTS
#: Bounds on what a Python worker holds; an executor has several, and what they took they keep.
SHINGLES_AT_ONCE = 20_000
TEXT_BYTES = 256 << 10
CELLS_AT_ONCE = 1 << 18


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts.

    A bit is set if more than half of the shingle hashes have it. A text with fewer words than a
    shingle has one, its whole word sequence; a text without words has fingerprint zero.
    """
    words, counts = split_words(translated(large_texts(texts), LOWER))
    data = b" ".join(words.cast(pa.large_binary()).to_pylist())
    lengths = pc.binary_length(words).to_numpy()
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = ends_of(counts)
    result = np.zeros(len(counts), np.uint64)
    digest = xxhash.xxh64_intdigest
    filled = np.flatnonzero(counts)
    shingles = np.maximum(counts[filled] - shingle + 1, 1)
    lot = (np.cumsum(shingles) - shingles) // SHINGLES_AT_ONCE
    for rows in np.split(np.arange(len(filled)), np.flatnonzero(np.diff(lot)) + 1):
        if not len(rows):
            continue
        begins, stops = [], []
        for row in filled[rows]:
            a, b = first[row], first[row + 1]
            begins.append(starts[a : max(a + 1, b - shingle + 1)])
            stops.append(ends[min(a + shingle, b) - 1 : b])
        spans = zip(np.concatenate(begins).tolist(), np.concatenate(stops).tolist(), strict=True)
        hashes = np.array([digest(data[p:q], SEED) for p, q in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = ends_of(shingles[rows])
        sums = np.add.reduceat(bits, cuts[:-1], axis=0, dtype=np.int64)
        majority = 2 * sums > shingles[rows][:, None]
        result[filled[rows]] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
    return result


def with_fingerprint(docs: DataFrame, shingle: int, name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with the fingerprint of ``text`` as a signed bigint ``name``."""
    text = fresh(docs.select(*keep), "_text")
    work = bounded_batches(docs).select(*keep, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in lots(whole, whole.num_columns - 1, TEXT_BYTES):
                prints = fingerprints_of(batch.column(batch.num_columns - 1), shingle)
                columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
                yield pa.record_batch(columns, names=[*keep, name])

    return work.mapInArrow(run, docs.select(*keep, F.lit(0).cast("bigint").alias(name)).schema)


def cell_of(fingerprint):
    """Bits set in each part, as digits of one number."""
    cell = F.lit(0)
    for part in range(PARTS):
        bits = F.shiftrightunsigned(fingerprint, part * PART_BITS).bitwiseAND((1 << PART_BITS) - 1)
        cell = cell * (PART_BITS + 1) + F.bit_count(bits)
    return cell


def steps_to_near_cells(radius: int) -> list[tuple[int, ...]]:
    """Differences of bit counts within the radius, one of each pair of opposite ones."""
    whole = product(range(-radius, radius + 1), repeat=PARTS)
    return [d for d in whole if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]


def near_pairs(
    left: np.ndarray, right: np.ndarray, same: bool, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two tiles within the radius, each once if the tiles are the same.

    They come in pieces of bounded size, as tiles of near copies hold very many.
    """
    rows = max(1, CELLS_AT_ONCE // max(1, len(right)))
    for start in range(0, len(left), rows):
        near = np.bitwise_count(left[start : start + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield left[i], right[j]


def fingerprint_components(
    prints: DataFrame, radius: int, tile_rows: int = 2048, most_rows: int | None = None
) -> DataFrame:
    """``(node, root)`` for every fingerprint of the one-column table ``prints`` with a partner.

    ``prints`` is distinct and not null. Nothing is skipped but tile pairs that cannot hold a
    link. A cell with many fingerprints is cut into tiles by hash, so no task or row grows with it.
    ``most_rows`` bounds the number of fingerprints, if known, and so the files written.
    """
    marked = prints.toDF("fp").withColumn("cell", cell_of(F.col("fp")))
    # One row per possible cell at most: (64 / PARTS + 1) ** PARTS, whatever the input.
    sizes = pinned(
        marked.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("chunks")),
        most_rows,
    )
    tiles = pinned(
        marked.join(F.broadcast(sizes), "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
        .groupBy("cell", "chunk")
        .agg(F.collect_list("fp").alias("fps")),
        most_rows,
    )
    base = PART_BITS + 1
    digits = [
        F.floor(F.col("cell") / base ** (PARTS - 1 - p)).cast("int") % base for p in range(PARTS)
    ]
    steps = F.array(
        *[F.array(*[F.lit(x) for x in step]) for step in steps_to_near_cells(radius)]
    )
    around = (
        tiles.select("cell", "chunk", F.col("fps").alias("left"), F.explode(steps).alias("step"))
        .filter(
            F.forall(
                F.zip_with(F.array(*digits), "step", lambda d, s: d + s),
                lambda x: x.between(0, PART_BITS),
            )
        )
        .withColumn(
            "other",
            F.aggregate("step", F.lit(0), lambda total, s: total * base + s) + F.col("cell"),
        )
    )
    pairs = (
        around.drop("step")
        .join(F.broadcast(sizes.toDF("other", "chunks")), "other")
        .withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .filter("other <> cell or other_chunk >= chunk")
        .join(tiles.toDF("other", "other_chunk", "right"), ["other", "other_chunk"])
        .select(
            "left",
            "right",
            F.expr("cell = other and chunk = other_chunk").alias("same"),
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for batch in batches:
                for row in range(len(batch)):
                    left, right = (
                        batch.column(c)[row].values.to_numpy().astype("<i8").view("<u8")
                        for c in (0, 1)
                    )
                    same = batch.column(2)[row].as_py()
                    for a, b in near_pairs(left, right, same, radius):
                        yield a.view("<i8"), b.view("<i8")

        yield from star_batches(links())

    return components(pairs.mapInArrow(compare, LINKS), reduced=True)


def simhash_groups(
    docs: DataFrame, shingle: int = 3, radius: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """Fingerprint and group of every row of ``docs``.

    Returns the ``keep`` columns (by default ``doc_id``), ``fingerprint`` as 16 hex digits and
    ``component_id``, the smallest ``doc_id`` among all rows reachable over fingerprints that
    differ in ``radius`` bits or fewer. Null and empty texts have fingerprint zero and are linked
    like any other; null ids count as absent, a group of null ids only has a null component.
    Repeated rows all stay. Other columns, whatever their names, are ignored. An empty table gives
    no rows.
    """
    keep = keep or ["doc_id"]
    name, id_name = fresh(docs, "_fp"), fresh(docs, "_id")
    source = docs.withColumn(id_name, F.col("doc_id"))
    rows = pinned(with_fingerprint(source, shingle, name, [*keep, id_name]))
    classes = pinned(
        rows.groupBy(F.col(name).alias("fp")).agg(F.min(id_name).alias("lowest")), rows.count()
    )
    n = classes.count()
    roots = pinned(fingerprint_components(classes.select("fp"), radius, most_rows=n), n)
    lowest = (
        roots.join(classes, F.col("node") == F.col("fp"))
        .groupBy("root")
        .agg(F.min("lowest").alias("joint"))
    )
    linked = roots.join(lowest, "root").select(F.col("node").alias("fp"), "joint")
    named = classes.join(linked, "fp", "left").select(
        F.col("fp").alias(name), F.coalesce("joint", "lowest").alias("component_id")
    )
    return rows.join(named, name).select(
        *keep, F.lower(F.lpad(F.hex(name), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_documents(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with one row of each group of :func:`simhash_groups` left.

    It is the one with the smallest ``doc_id``, nulls last; of repeated ids any one row. All columns
    stay, null and empty texts are a group like any other.
    """
    rows, row_id = with_row_id(docs)
    groups = simhash_groups(rows, shingle, radius, [row_id, "doc_id"])
    # A group is told apart by its id; a group of null ids only, by its fingerprint.
    first = groups.groupBy(
        "component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    ).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row_id)).alias("first"))
    kept = first.select(F.col("first")[row_id].alias(row_id))
    return rows.join(kept, row_id, "left_semi").select(*docs.columns)
