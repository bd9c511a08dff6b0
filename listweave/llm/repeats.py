"""Repeated passages of documents, by a distributed merge sort of suffixes.

A passage repeats if a document with a smaller id holds the same string of ``length`` bytes. Four
steps find all of them:

1. Texts are packed in blocks. A string of ``length`` bytes is owned by its anchor: the place of the
   least hash among its grams of 24 bytes. Equal strings have equal grams at their anchors. Blocks
   exchange hashes of those grams; where a gram is in one document only, nothing repeats, and the
   suffix at that anchor stays out of the sort.
2. For the other anchors, each block sorts the suffixes there, with all the anchor owns to its right
   and left, and exchanges them as front-coded runs. Parts of the order are merged by trees of
   losers that never compare a known prefix again. What equals that of an earlier document repeats.
3. Where the merge shows anchors with one gram but different surroundings, the strings they own, as
   far as the next suffix in order allows for equal ones, are sorted as suffixes of their own,
   exchanged and merged in the same way.
4. The repeats return to their blocks, which cut them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.llm.common import bounded_batches, ends_of, large_texts, lots, ranges
from listweave.llm.suffix_runs import (
    ROWS_AT_ONCE,
    Entries,
    as_keys,
    earliest,
    merged,
    pieces,
    sorted_run,
)
from listweave.session import pinned

LENGTH = 50
GRAM = 24
#: Text of a block, of a part of the sorted order on average, and places hashed at once.
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20
PLACES_AT_ONCE = 1 << 20
#: Strings that each block gives for the choice of the parts' limits, and the stretches they are from.
SAMPLES = 16
STRETCH = 512

BLOCKS = (
    "block bigint, bytes bigint, ids binary, known binary, sizes binary, text binary, "
    "some_anchors binary, some_strings binary"
)
MARKS = "bucket int, block bigint, marks binary, several binary"
SENT = "part int, run binary, block bigint, repeats binary"
SENT_ARROW = pa.schema(
    [("part", pa.int32()), ("run", pa.binary()), ("block", pa.int64()), ("repeats", pa.binary())]
)
NAMES = SENT_ARROW.names
FOUND = (
    "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
)
FOUND_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.large_binary()),
    ]
)


@dataclass
class Anchors:
    """Per anchor the first string it owns, how many it owns, its place and its gram's hash."""

    start: np.ndarray
    count: np.ndarray
    at: np.ndarray
    hash: np.ndarray


@dataclass
class Block:
    """The documents of a block: their ids (of those that have one) and sizes, their bytes."""

    number: int
    ids: np.ndarray
    known: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        text = zstandard.ZstdDecompressor().decompress(row["text"], max(1, row["bytes"]))
        return cls(
            row["block"],
            np.frombuffer(row["ids"], np.int64),
            np.frombuffer(row["known"], bool),
            np.frombuffer(row["sizes"], np.int64),
            np.frombuffer(text, np.uint8),
        )

    def doc_at(self, place: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(np.cumsum(self.sizes), place, side="right")]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every 24 bytes."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), strides=(1,))
    mixed = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    mixed += words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += words[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
    return scrambled(mixed)


def scrambled(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    return values


def least_within(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive keys."""
    least, reach = keys, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    more = span - reach
    return np.minimum(least[:-more], least[more:]) if more else least


def anchors_of(block: Block, length: int) -> Anchors:
    """Anchors of all strings of ``length`` bytes within the documents that have an id."""
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(block.sizes)
    places = len(block.data) - length + 1
    low_bits = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, places), PLACES_AT_ONCE):
        n = min(PLACES_AT_ONCE, places - at)
        hashes = gram_hashes(block.data[at : at + n + length - 1])
        keys = (hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (least_within(keys, length - GRAM + 1) & low_bits).astype(np.int64)
        # Strings that reach beyond their document, or are of one without id, are none.
        inside = np.ones(n, bool)
        from_doc, to_doc = np.searchsorted(ends, [at, at + n - 1], side="right")
        for doc in range(from_doc, min(to_doc, len(ends) - 1) + 1):
            begins = ends[doc] - block.sizes[doc]
            first_bad = max(begins, ends[doc] - length + 1) if block.known[doc] else begins
            inside[max(0, first_bad - at) : max(0, ends[doc] - at)] = False
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(new)
        if len(starts):
            counts = np.add.reduceat(inside, starts, dtype=np.int64)
            own = anchor[starts]
            found.append((starts + at, counts, own + at, hashes[own]))
    if not found:
        return Anchors(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def anchor_strings(data: np.ndarray, some: Anchors, length: int) -> np.ndarray:
    """Per anchor the bytes from there on as far as what it owns reaches, how far that is to the right
    and left, then backwards the bytes to the left; unused bytes are zero."""
    side = length - GRAM
    strings = np.zeros((len(some.at), length + 2 + side), np.uint8)
    right = some.start + some.count - 1 + length - some.at
    left = some.at - some.start
    strings[:, length], strings[:, length + 1] = right, left
    last = len(data) - 1
    for at in range(0, len(strings), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        place = some.at[rows, None]
        ahead = np.arange(length)
        taken = data[np.minimum(place + ahead, last)]
        strings[rows, :length] = taken * (ahead < right[rows, None])
        back = np.arange(side)
        taken = data[np.maximum(place - 1 - back, 0)]
        strings[rows, length + 2 :] = taken * (back < left[rows, None])
    return strings


def owned_strings(some: Entries, length: int, reach: np.ndarray) -> Entries:
    """The strings that the anchors own, one by one, as far as they end within ``reach`` bytes from
    the anchor. They come in order of place, so those are the first ones of each anchor."""
    left = some.strings[:, length + 1].astype(np.int64)
    count = np.clip(reach - length + left + 1, 0, some.count)
    rows = np.repeat(np.arange(len(some)), count)
    nth = ranges(np.zeros(len(some), np.int64), count)
    strings = np.empty((len(rows), length), np.uint8)
    for at in range(0, len(rows), ROWS_AT_ONCE):
        row = rows[at : at + ROWS_AT_ONCE, None]
        # Places relative to the anchor; to the left they are stored backwards.
        place = nth[at : at + ROWS_AT_ONCE, None] - left[row] + np.arange(length)
        column = np.where(place < 0, length + 1 - place, place)
        strings[at : at + ROWS_AT_ONCE] = some.strings[row, column]
    return Entries(
        strings, some.doc[rows], some.block[rows], some.start[rows] + nth, np.ones(len(rows), np.int64)
    )


def intervals(start: np.ndarray, count: np.ndarray) -> bytes:
    """Stretches of places, sorted, with those that touch as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + count)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    flat = np.concatenate([start[first], reach[last]]).astype(np.int64)
    return zstandard.ZstdCompressor(3).compress(flat.tobytes())


def read_intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
    return flat[: len(flat) // 2], flat[len(flat) // 2 :]


def sent(parts: list, runs: list, blocks: list, repeats: list) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(parts, pa.int32()),
            pa.array(runs, pa.binary()),
            pa.array(blocks, pa.int64()),
            pa.array(repeats, pa.binary()),
        ],
        schema=SENT_ARROW,
    )


def sent_runs(run: Entries, shared: np.ndarray, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, data in pieces(run, shared, splitters):
        yield sent([part], [data], [None], [None])


def sent_repeats(late: Entries, part: int | None) -> Iterator[pa.RecordBatch]:
    """Repeats by block. They travel with a part, if a merge of parts is still to come."""
    if not len(late):
        return
    order = np.argsort(late.block, kind="stable")
    blocks, first = np.unique(late.block[order], return_index=True)
    for block, rows in zip(blocks.tolist(), np.split(order, first[1:]), strict=True):
        yield sent([part], [None], [block], [intervals(late.start[rows], late.count[rows])])


def packed(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Ids and texts in blocks of about ``block_bytes``, with some strings of each for the limits."""

    def pack(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        data = texts.buffers()[2]
        plain = data.to_pybytes() if len(texts) and data is not None else b""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        block = Block(
            number,
            pc.fill_null(ids, 0).to_numpy(),
            known,
            sizes,
            np.frombuffer(plain, np.uint8),
        )
        anchors, strings = [], []
        step = max(STRETCH, -(-len(plain) // SAMPLES))
        for at in range(0, len(plain) - STRETCH + 1, step):
            stretch = Block(
                0, np.zeros(1, np.int64), np.ones(1, bool), np.array([STRETCH]),
                block.data[at : at + STRETCH],
            )
            some = anchors_of(stretch, length)
            # One with neighbours on both sides owns all it does elsewhere.
            middle = slice(len(some.at) // 2, len(some.at) // 2 + 1)
            chosen = Anchors(
                some.start[middle], some.count[middle], some.at[middle], some.hash[middle]
            )
            anchors.append(anchor_strings(stretch.data, chosen, length).tobytes())
            strings.append(plain[at : at + length])
        row = [
            [number],
            [len(plain)],
            [block.ids.tobytes()],
            [known.tobytes()],
            [sizes.tobytes()],
            [zstandard.ZstdCompressor(3).compress(plain)],
            [b"".join(anchors)],
            [b"".join(strings)],
        ]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        arrays = [pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)]
        return pa.record_batch(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pack(number, table.column(0).combine_chunks(), large_texts(table.column(1)))

        for whole in batches:
            for batch in lots(whole, 1, block_bytes):
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
                if size >= block_bytes:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, BLOCKS)


def gram_marks(
    block: Block, anchors: Anchors, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the grams, in order; whether several documents of the block have them;
    where the hashes of each bucket end. A bucket holds a range of hashes."""
    doc = block.doc_at(anchors.at)
    marks = scrambled(anchors.hash)
    order = np.argsort(marks, kind="stable")
    marks, doc = marks[order], doc[order]
    new = np.ones(len(marks), bool)
    new[1:] = marks[1:] != marks[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return marks, np.zeros(0, bool), np.zeros(buckets + 1, np.int64)
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    marks = marks[first]
    width = -(-(1 << 64) // buckets)
    limits = np.array([b * width for b in range(1, buckets)], np.uint64)
    return marks, several, np.concatenate([[0], np.searchsorted(marks, limits), [len(marks)]])


def marks_of_blocks(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """Hashes of each block's grams by bucket. The bucket and 32 bits within it tell them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                marks, several, cuts = gram_marks(block, anchors_of(block, length), buckets)
                short = short_marks(marks, buckets)
                own = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.record_batch(
                    [
                        pa.array(own, pa.int32()),
                        pa.array([block.number] * len(own), pa.int64()),
                        pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in own], pa.binary()),
                        pa.array(
                            [np.packbits(several[cuts[b] : cuts[b + 1]]).tobytes() for b in own],
                            pa.binary(),
                        ),
                    ],
                    names=["bucket", "block", "marks", "several"],
                )

    return blocks.select("block", "bytes", "ids", "known", "sizes", "text").mapInArrow(run, MARKS)


def short_marks(marks: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of each hash, below those that name its bucket."""
    spare = max(0, 32 - (buckets - 1).bit_length())
    return ((marks >> np.uint64(spare)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shared_marks(group: pa.Table) -> pa.Table:
    """For each block whether the grams of a bucket are in several documents, as bits."""
    blocks = group.column("block").to_pylist()
    marks = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("marks")]
    lengths = [len(x) for x in marks]
    several = np.concatenate(
        [
            np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n)
            for x, n in zip(group.column("several"), lengths, strict=True)
        ]
    )
    _, which, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    shared = (counts[which] > 1) | several.astype(bool)
    cuts = ends_of(np.array(lengths))
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table(
        {
            "block": pa.array(blocks, pa.int64()),
            "bucket": pa.array(group.column("bucket").to_pylist(), pa.int32()),
            "shared": pa.array(bits, pa.binary()),
        }
    )


def limits(blocks: DataFrame, column: str, width: int, parts: int) -> np.ndarray:
    """The strings that cut the order into ``parts`` of about equal numbers of the samples. As for
    Spark's own ranges, a few samples a block come to the driver."""
    data = b"".join(bytes(x[0]) for x in blocks.select(column).collect())
    keys = np.unique(as_keys(np.frombuffer(data, np.uint8).reshape(-1, width)))
    if parts < 2 or not len(keys):
        return keys[:0]
    return np.unique(keys[np.linspace(0, len(keys), parts + 1).astype(np.int64)[1:-1]])


def anchor_runs(blocks: DataFrame, length: int, buckets: int, splitters: np.ndarray) -> DataFrame:
    """Each block's suffixes at the anchors whose grams are shared, as runs by part, and what
    already repeats within the block. Blocks come with ``flags``, the bits of their buckets."""
    limits_sent = blocks.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                anchors = anchors_of(block, length)
                marks, _, cuts = gram_marks(block, anchors, buckets)
                shared = np.zeros(len(marks), bool)
                for flag in row["flags"] or []:
                    a, b = cuts[flag["bucket"]], cuts[flag["bucket"] + 1]
                    bits = np.frombuffer(flag["shared"], np.uint8)
                    shared[a:b] = np.unpackbits(bits, count=b - a)
                wanted = shared[np.searchsorted(marks, scrambled(anchors.hash))]
                some = Anchors(*(x[wanted] for x in vars(anchors).values()))
                if not len(some.at):
                    continue
                entries = Entries(
                    anchor_strings(block.data, some, length),
                    block.doc_at(some.at),
                    np.full(len(some.at), block.number),
                    some.start,
                    some.count,
                )
                kept, prefixes, late = sorted_run(entries)
                yield from sent_runs(kept, prefixes, limits_sent.value)
                yield from sent_repeats(late, int(block.number % (len(limits_sent.value) + 1)))

    return blocks.mapInArrow(run, SENT)


def merged_anchors(runs: DataFrame, length: int, parts: int, splitters: np.ndarray) -> DataFrame:
    """Repeats by equal suffixes at anchors, and runs of the strings that are still to be compared:
    those of anchors that are not alone with their gram."""
    limits_sent = runs.sparkSession.sparkContext.broadcast(splitters)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        earlier = group.filter(pc.is_valid(group.column("block"))).select(NAMES).cast(SENT_ARROW)
        return pa.Table.from_batches([*earlier.to_batches(), *compared(key, group)], SENT_ARROW)

    def compared(key: tuple, group: pa.Table) -> Iterator[pa.RecordBatch]:
        data = [x for x in group.column("run").to_pylist() if x is not None]
        if not data:
            return
        entries, shared = merged(data)
        new = shared < entries.strings.shape[1]
        new[0] = True
        late = entries.doc > earliest(entries.doc, new)
        yield from sent_repeats(entries.take(late), None)
        # How much of the bytes from the anchor on a group shares with the most similar other one:
        # a string that ends beyond that is in no other. Those at the limits of a part may have their
        # neighbours in another part.
        part = key[0].as_py()
        first = np.flatnonzero(new)
        with_next = np.append(shared[first[1:]], 0)
        with_before = np.append(0, with_next[:-1])
        if part > 0:
            with_before[0] = length
        if part < parts - 1:
            with_next[-1] = length
        reach = np.minimum(np.maximum(with_before, with_next), length)
        reach[reach < GRAM] = 0
        of_entry = reach[np.cumsum(new) - 1]
        open_ones = (of_entry > 0) & ~late
        strings = owned_strings(entries.take(open_ones), length, of_entry[open_ones])
        run, prefixes, repeated = sorted_run(strings)
        yield from sent_repeats(repeated, None)
        yield from sent_runs(run, prefixes, limits_sent.value)

    return runs.groupBy("part").applyInArrow(merge, SENT)


def merged_strings(runs: DataFrame) -> DataFrame:
    """Repeats by equal strings."""

    def merge(group: pa.Table) -> pa.Table:
        entries, shared = merged(group.column("run").to_pylist())
        new = shared < entries.strings.shape[1]
        new[0] = True
        late = entries.take(entries.doc > earliest(entries.doc, new))
        return pa.Table.from_batches(sent_repeats(late, None), SENT_ARROW)

    return runs.groupBy("part").applyInArrow(merge, SENT)


def cut_documents(blocks: DataFrame, length: int) -> DataFrame:
    """Documents of the blocks without what repeats. Blocks come with ``repeats``, all stretches of
    places whose strings repeat."""

    def cut(row: dict) -> pa.RecordBatch:
        block = Block.of(row)
        edge = np.zeros(len(block.data) + 1, np.int32)
        for data in row["repeats"] or []:
            start, end = read_intervals(data)
            np.add.at(edge, start, 1)
            np.add.at(edge, end - 1 + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(block.sizes)
        starts = ends - block.sizes
        turn = np.flatnonzero(gone[1:] != gone[:-1]) + 1 if len(gone) else np.zeros(0, np.int64)
        # Places where runs begin and end, also at limits of documents.
        inner = starts[(starts > 0) & (starts < len(gone))]
        cuts = np.unique(np.concatenate([[0], turn, inner, [len(gone)]]))
        begins, stops = cuts[:-1], cuts[1:]
        removed = gone[begins] if len(gone) else np.zeros(len(begins), bool)
        begins, stops = begins[removed], stops[removed]
        owner = np.searchsorted(ends, begins, side="right")
        per_doc = np.bincount(owner, minlength=len(ends))
        shift = starts[owner]
        spans = pa.StructArray.from_arrays(
            [pa.array(begins - shift, pa.int64()), pa.array(stops - shift, pa.int64())],
            names=["start", "end"],
        )
        lost = np.bincount(owner, weights=stops - begins, minlength=len(ends)).astype(np.int64)
        kept = pa.Array.from_buffers(
            pa.large_binary(),
            len(ends),
            [None, pa.py_buffer(ends_of(block.sizes - lost)), pa.py_buffer(block.data[~gone].tobytes())],
        )
        return pa.record_batch(
            [
                pa.array(block.ids, pa.int64(), mask=~block.known),
                pa.array(block.sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends_of(per_doc), pa.int32()), spans),
                kept,
            ],
            schema=FOUND_ARROW,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = cut(row)
                yield pa.record_batch(
                    [*whole.columns[:3], whole.column(3).cast(pa.binary())],
                    names=whole.schema.names,
                )

    return blocks.mapInArrow(run, FOUND)


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per document its id, ``n_bytes``, the ``spans`` of bytes that repeat (from, to before) and
    the bytes ``kept``.

    A byte repeats if it lies in a string of ``length`` bytes that also starts in a document with a
    smaller id, judged on the texts as they are given. ``length`` is from 32 to 200 bytes.

    Null texts are empty; texts shorter than ``length`` keep all. Documents with one id never repeat
    each other; those without id repeat nothing and lose nothing. Repeated rows give a row each, an
    empty table none. Other columns are ignored. Cuts may fall within a character, so ``kept`` is
    binary.
    """
    if not 32 <= length <= 200:
        raise ValueError("length is from 32 to 200 bytes")
    bounded_batches(docs)
    blocks = pinned(packed(docs, length, block_bytes))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    wide = length + 2 + (length - GRAM)
    of_anchors = limits(blocks, "some_anchors", wide, parts)
    of_strings = limits(blocks, "some_strings", length, parts)
    texts = blocks.drop("some_anchors", "some_strings")
    flags = (
        marks_of_blocks(texts, length, parts)
        .groupBy("bucket")
        .applyInArrow(shared_marks, "block bigint, bucket int, shared binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "shared")).alias("flags"))
    )
    flagged = texts.join(pinned(flags), "block")
    runs = anchor_runs(flagged, length, parts, of_anchors)
    first = pinned(merged_anchors(runs, length, len(of_anchors) + 1, of_strings))
    second = merged_strings(first.filter("run is not null"))
    repeats = (
        first.filter("block is not null")
        .unionByName(second)
        .groupBy("block")
        .agg(F.collect_list("repeats").alias("repeats"))
    )
    return cut_documents(texts.join(pinned(repeats), "block", "left"), length)
