"""Hard negatives by exact integer inner products, scored by the method of the Four Russians.

The components of a vector are small integers. A candidate keeps them as bit planes: for each bit
and each group of eight dimensions one byte. For an anchor all 256 subset sums of each group of
eight of its components are made once; the inner product is then a sum of table entries, looked up
by the candidate's bytes and shifted by the bit they stand for.

Anchors come in waves of bounded size, each broadcast to blocks of candidates that never move. A
task keeps only the best few rows per anchor over all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listweave.llm.common import bounded_batches, with_row_id
from listweave.session import pinned, run_folder

GROUP = 8
SCALE = 256
#: Candidates of a packed block, and how many anchors are broadcast at once on average.
BLOCK_ROWS = 4_096
WAVE_ANCHORS = 2_048
#: Anchors whose scores against a block are held at once.
ANCHORS_AT_ONCE = 128
#: Scaled components from here on are no numbers a sum of products in 64 bits is sure to hold.
TOO_LARGE = 1 << 25

PACKED = "n int, ids binary, rows binary, labels binary, planes binary"
BEST = "anchor_row bigint, place int, score bigint, id bigint, id_row bigint"
RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)


def plane_bytes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of integers in two's complement: ``[bit, group, row]`` bytes, the first dimension
    of a group in the lowest bit."""
    n, dims = values.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :dims] = values
    planes = np.empty((bits, groups, n), np.uint8)
    for bit in range(bits):
        ones = ((wide >> bit) & 1).astype(np.uint8)
        planes[bit] = np.packbits(ones, axis=1, bitorder="little").T
    return planes


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """``[group, byte, anchor]``: the sum of the anchor's components at the set bits of the byte."""
    count, dims = anchors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((count, groups * GROUP), kind)
    wide[:, :dims] = anchors
    table = np.zeros((groups, 1 << GROUP, count), kind)
    for g in range(groups):
        for j in range(GROUP):
            half = 1 << j
            table[g, half : 2 * half] = table[g, :half] + wide[:, g * GROUP + j]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products ``[row, anchor]``, from the highest bit, which counts negative, downwards."""
    bits, groups, n = planes.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    looked_up = np.empty_like(total)
    for bit in range(bits - 1, -1, -1):
        for g in range(groups):
            np.take(table[g], planes[bit, g], axis=0, out=looked_up, mode="clip")
            total += looked_up
        if bit == bits - 1:
            np.negative(total, out=total)
        if bit:
            total *= 2
    return total


def sum_type(dims: int, bits: int) -> type:
    """32 bits if they hold every sum of ``dims`` products of components of ``bits`` bits."""
    return np.int32 if dims << (2 * bits - 2) < 1 << 31 else np.int64


def packed_blocks(rows: DataFrame, row: str, dims: int, bits: int) -> DataFrame:
    """The rows in blocks of bounded size, in order of id and row within a block."""

    def pack(ids, own, labels, values) -> pa.RecordBatch:
        order = np.lexsort([own, ids])
        parts = [ids[order], own[order], labels[order], plane_bytes(values[order], bits)]
        arrays = [pa.array([p.tobytes()], pa.binary()) for p in parts]
        names = ["n", "ids", "rows", "labels", "planes"]
        return pa.record_batch([pa.array([len(ids)], pa.int32()), *arrays], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids, own, labels = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            held.append((ids, own, labels, matrix(batch.column(3), dims)))
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("vec_id", row, "label", "q").mapInArrow(run, PACKED)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers; a shorter list ends in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.int64)
    if len(lengths) * dims == len(values) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    result = np.zeros((len(lengths), dims), np.int64)
    result[np.arange(dims) < lengths[:, None]] = values
    return result


class Best:
    """The first rows of a task by score (highest first), id and row, per place of each anchor."""

    def __init__(self, anchors: int, places: int, keep: int):
        self.keep = keep
        self.found: list[list[tuple[np.ndarray, ...]]] = [
            [(np.zeros(0, np.int64),) * 3 for _ in range(places)] for _ in range(anchors)
        ]

    def least(self, anchor: int, place: int) -> int | None:
        """The lowest score that can still come in; any score while there is room."""
        held = self.found[anchor][place][0]
        return int(held[-1]) if len(held) == self.keep else None

    def add(self, anchor: int, place: int, values, ids, rows) -> None:
        old = self.found[anchor][place]
        value, own, row = (np.concatenate(x) for x in zip(old, (values, ids, rows), strict=True))
        first = np.lexsort([row, own, -value])[: self.keep]
        self.found[anchor][place] = (value[first], own[first], row[first])

    def batches(self, anchor_rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BEST.split(", ")]
        for at in range(0, len(self.found), ANCHORS_AT_ONCE):
            some = [
                (anchor_rows[a], place, held)
                for a in range(at, min(at + ANCHORS_AT_ONCE, len(self.found)))
                for place, held in enumerate(self.found[a])
                if len(held[0])
            ]
            if some:
                counts = [len(held[0]) for _, _, held in some]
                columns = [
                    pa.array(np.repeat([r for r, _, _ in some], counts), pa.int64()),
                    pa.array(np.repeat([p for _, p, _ in some], counts), pa.int32()),
                    *(
                        pa.array(np.concatenate([held[i] for _, _, held in some]), pa.int64())
                        for i in range(3)
                    ),
                ]
                yield pa.record_batch(columns, names=names)


def best_rows(
    blocks: DataFrame, wave: dict, bands: list[list[tuple[int, int]]] | None, keep: int, bits: int
) -> DataFrame:
    """Per task and anchor of the wave the first ``keep`` rows. Without ``bands`` they are other
    rows of the anchor's label, in place 0; with them rows of other labels whose score lies within
    the band, for each band of the anchor a place."""
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast((wave["rows"], wave["labels"], wave["values"], bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_rows, anchor_labels, values, bands = sent.value
        dims = values.shape[1]
        groups = -(-dims // GROUP)
        kind = sum_type(dims, bits)
        best = Best(len(values), max([1, *map(len, bands or [])]), keep)
        for batch in batches:
            for block in batch.to_pylist():
                ids, rows, labels = (
                    np.frombuffer(block[c], np.int64) for c in ("ids", "rows", "labels")
                )
                planes = np.frombuffer(block["planes"], np.uint8).reshape(bits, groups, len(ids))
                for at in range(0, len(values), ANCHORS_AT_ONCE):
                    table = subset_sums(values[at : at + ANCHORS_AT_ONCE], kind)
                    of_anchor = np.ascontiguousarray(scores(table, planes).T)
                    for a, score in enumerate(of_anchor, at):
                        same = labels == anchor_labels[a]
                        allowed = same & (rows != anchor_rows[a]) if bands is None else ~same
                        ranges = [(None, None)] if bands is None else bands[a]
                        for place, (low, high) in enumerate(ranges):
                            least = best.least(a, place)
                            low = least if low is None or least is not None and least > low else low
                            some = allowed if low is None else allowed & (score >= low)
                            some = some if high is None else some & (score <= high)
                            chosen = np.flatnonzero(some)
                            if len(chosen):
                                value = score[chosen].astype(np.int64)
                                best.add(a, place, value, ids[chosen], rows[chosen])
        yield from best.batches(anchor_rows)

    return blocks.mapInArrow(run, BEST)


def first_places(found: DataFrame, keep: int, name: str) -> DataFrame:
    order = [F.desc("score"), F.col("id"), F.col("id_row")]
    place = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(*order))
    return found.withColumn(name, place).filter(F.col(name) <= keep)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id``, ``label`` and the scaled integer components ``q`` of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.lit(float(SCALE)) * x.cast("double"))
    fits = F.forall("_scaled", lambda x: F.coalesce(F.abs(x) < TOO_LARGE, F.lit(False)))
    return (
        vectors.select(F.col("vec_id").cast("bigint"), label.alias("label"), scaled.alias("_scaled"))
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fits)
        .select("vec_id", "label", F.transform("_scaled", lambda x: F.floor(x).cast("int")).alias("q"))
    )


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    wave_anchors: int = WAVE_ANCHORS,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels whose score is from ``least_percent`` to ``most_percent`` of
    the positive's: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``.

    A component ``x`` counts as ``floor(256 * x)``; scores are exact integer inner products. Higher
    scores come first, ties by ``vec_id``. ``label`` and ``is_anchor`` are expressions over
    ``vectors`` and ``vec_id``.

    Rows without id, label or vector take no part, nor do rows with a null or non-finite component
    or one of 131,072 and beyond, whose products 64 bits may not hold. An empty vector scores zero,
    a shorter one as if it ended in zeros. Repeated rows are rows of their own, ordered among equal
    ids by arrival: each repeated anchor gives its rows, and its own copy is another row to it. An
    anchor without positives, and an empty table, give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(vectors)
    rows, row = with_row_id(usable(vectors, label))
    magnitude = F.aggregate("q", F.lit(0), lambda a, x: F.greatest(a, F.abs(x)))
    facts = rows.agg(
        F.max(F.size("q")).alias("dims"),
        F.max(magnitude).alias("peak"),
        F.count_if(is_anchor).alias("anchors"),
    ).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], RESULT)
    dims, bits = max(1, facts["dims"]), int(facts["peak"]).bit_length() + 1
    blocks = pinned(packed_blocks(rows, row, dims, bits))
    waves = -(-facts["anchors"] // wave_anchors)
    in_wave = F.pmod(F.xxhash64(row), F.lit(waves))
    folder = run_folder(spark, "negatives")
    for number in range(waves):
        # A wave of the anchors, of bounded size, with their positives.
        some = rows.filter(is_anchor & (in_wave == number)).select(row, "vec_id", "label", "q")
        lines = some.collect()
        values = np.zeros((len(lines), dims), np.int64)
        for i, line in enumerate(lines):
            values[i, : len(line["q"])] = line["q"]
        wave = {
            "rows": np.array([x[0] for x in lines], np.int64),
            "labels": np.array([x["label"] for x in lines], np.int64),
            "values": values,
        }
        near = first_places(best_rows(blocks, wave, None, positives, bits), positives, "nth")
        of_anchor: dict[int, list] = {x[0]: [] for x in lines}
        for found in near.sort("anchor_row", "nth").collect():
            of_anchor[found["anchor_row"]].append((found["id"], found["score"]))
        bands = [
            [(-(-least_percent * s // 100), most_percent * s // 100) for _, s in of_anchor[x[0]]]
            for x in lines
        ]
        named = [
            (x[0], place, x["vec_id"], own, score)
            for x in lines
            for place, (own, score) in enumerate(of_anchor[x[0]])
        ]
        names = "anchor_row bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint"
        pairs = F.broadcast(spark.createDataFrame(named, names))
        far = first_places(best_rows(blocks, wave, bands, negatives, bits), negatives, "rank")
        far.join(pairs, ["anchor_row", "place"]).select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(f"{folder}/wave={number}")
    return spark.read.schema(RESULT).parquet(*[f"{folder}/wave={n}" for n in range(waves)])
