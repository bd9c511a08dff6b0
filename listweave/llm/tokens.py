"""Token ids as Arrow files of equal-length sequences with masks.

Documents are encoded in ascending order of id. Every task writes one file of its range: record
batches of a fixed number of rows, each row a fixed-size list of ids and one of mask values, so
sequence i of a file is found by division and read without copying. A second file holds where each
document starts. The last sequence of a file is padded, with mask zero.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listweave.llm.common import bounded_batches, ends_of, file_system, large_texts, lots, ranges
from listweave.session import pinned, run_folder

END_ID = 2
SEQUENCE = 2048
ROWS_PER_BATCH = 256
TEXT_BYTES = 8 << 20
#: Bound on the remembered pieces of a task; they are forgotten all at once beyond it.
MOST_PIECES = 500_000
#: A space next to white space: such a text is encoded whole.
ODD_SPACE = "{0} | {0}".format(r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]")
#: Pieces that are encoded in one go.
JOINED = 50
MANIFEST = "part int, path string, docs bigint, tokens bigint, sequences bigint"


class Encoder:
    """Ids of texts, with the ids of pieces between spaces remembered.

    A space between two signs that are not white space always begins a new pre-token, so texts are
    cut there and each distinct piece is encoded once. The content of an added token is that token,
    as the library has it by default, and such texts are encoded whole; with ``literal`` it is text
    like any other.
    """

    def __init__(self, path: str, literal: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [] if literal else [t.content for t in added]
        self.spaced = any(" " in content for content in self.added)
        if literal:
            self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        # In a byte-level vocabulary every sign of a token stands for one byte.
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary))
        self.token_bytes = np.array([len(t) for t in tokens], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lists = [e.ids for e in found]
        ids = np.fromiter((i for x in lists for i in x), np.uint32)
        return ids, np.array([len(x) for x in lists], np.int64)

    def _encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_encode`, for pieces that begin with a space. A string of them falls apart at
        those spaces, and the bytes of the tokens tell where."""
        lots = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids, _ = self._encode(lots)
        ends = np.cumsum([len(p.encode()) for p in pieces])
        cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
        return ids, np.diff(cuts, prepend=0)

    def _learn(self, pieces: list[str], joined: bool) -> None:
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        ids, lengths = self._encode_joined(new) if joined else self._encode(new)
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        pieces = lists.flatten()
        opening = np.zeros(len(pieces), bool)
        opening[ends_of(counts)[:-1]] = True
        code = np.empty(len(pieces), np.int64)
        for chosen, space in ((opening, ""), (~opening, " ")):
            coded = pieces.filter(pa.array(chosen)).dictionary_encode()
            named = [space + p for p in coded.dictionary.to_pylist()]
            self._learn(named, joined=bool(space) and not self.spaced)
            if named:
                numbers = np.array([self.known[p] for p in named], np.int64)
                code[chosen] = numbers[coded.indices.to_numpy()]
        starts = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[code]
        sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), lengths, len(counts))
        return self.ids[ranges(starts[code], lengths)], sizes.astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        texts = large_texts(texts)
        if len(self.known) > MOST_PIECES:
            self._forget()
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        is_odd = odd.to_numpy(zero_copy_only=False)
        if not is_odd.any():
            return self._encode_pieces(texts)
        ids, lengths = self._encode_pieces(texts.filter(pc.invert(odd)))
        whole_ids, whole_lengths = self._encode(texts.filter(odd).to_pylist())
        sizes = np.empty(len(texts), np.int64)
        sizes[~is_odd], sizes[is_odd] = lengths, whole_lengths
        result = np.empty(sizes.sum(), np.uint32)
        of_odd = np.repeat(is_odd, sizes)
        result[~of_odd], result[of_odd] = ids, whole_ids
        return result, sizes


def id_kind(vocabulary: int) -> np.dtype:
    """Two bytes an id where they suffice."""
    return np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema(
        [
            ("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)),
            ("mask", pa.list_(pa.bool_(), length)),
        ],
        metadata={"rows_per_batch": str(ROWS_PER_BATCH), "sequence": str(length)},
    )


class SequenceWriter:
    """Cuts a stream of ids into batches of equal-length sequences."""

    def __init__(self, sink, length: int, kind: np.dtype) -> None:
        self.length = length
        self.kind = kind
        self.block = length * ROWS_PER_BATCH
        self.schema = sequence_schema(length, kind)
        self.writer = ipc.new_file(sink, self.schema)
        self.rest = np.zeros(0, kind)
        self.sequences = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)
        ]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += len(ids) // self.length

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        full = len(ids) // self.block * self.block
        for start in range(0, full, self.block):
            self._write(ids[start : start + self.block], self.block)
        self.rest = ids[full:]

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.length) * self.length, self.kind)
            padded[: len(self.rest)] = self.rest
            self._write(padded, len(self.rest))
        self.writer.close()


class TokenFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str) -> None:
        system, place = file_system(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(place) if local else system.open_input_file(place)
        self.reader = ipc.open_file(self.source)
        metadata = self.reader.schema.metadata
        self.rows = int(metadata[b"rows_per_batch"])
        self.length = int(metadata[b"sequence"])

    def __len__(self) -> int:
        batches = self.reader.num_record_batches
        return (batches - 1) * self.rows + len(self.reader.get_batch(batches - 1)) if batches else 0

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, as views of the file."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        batch = self.reader.get_batch(number // self.rows)
        ids, mask = (c[number % self.rows].values for c in batch.columns)
        return ids.to_numpy(), mask

    def batches(self) -> Iterator[np.ndarray]:
        """All ids, padding included, one batch at a time."""
        for number in range(self.reader.num_record_batches):
            yield self.reader.get_batch(number).column(0).flatten().to_numpy()


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, length: int = SEQUENCE
) -> DataFrame:
    """Writes all rows of ``docs`` (``doc_id``, ``text``) and returns the stored manifest.

    A file counts once it is in the manifest: a task that is run again writes another file. Ties of
    ``doc_id`` are ordered by hash of the text, null ids come first.
    """
    numbered = bounded_batches(docs).select(
        "doc_id",
        "text",
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = numbered.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions(
        "doc_id", "tie", "row"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        n_docs = n_tokens = 0
        system, place = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for whole in batches:
            for batch in lots(whole, 1, TEXT_BYTES):
                if writer is None:
                    encoder = Encoder(tokenizer_path, literal=False)
                    system.create_dir(place, recursive=True)
                    sink = system.open_output_stream(f"{place}/{name}.arrow")
                    index_sink = system.open_output_stream(f"{place}/{name}.index.arrow")
                    writer = SequenceWriter(sink, length, id_kind(encoder.vocabulary))
                    index_schema = pa.schema(
                        [
                            ("doc_id", batch.schema.field(0).type),
                            ("start", pa.int64()),
                            ("n_tokens", pa.int64()),
                        ]
                    )
                    index = ipc.new_file(index_sink, index_schema)
                ids, sizes = encoder.encode(batch.column(1))
                ended = np.full(len(ids) + len(sizes), END_ID, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                sizes = sizes + 1
                starts = n_tokens + np.cumsum(sizes) - sizes
                index.write_batch(
                    pa.record_batch(
                        [batch.column(0), pa.array(starts), pa.array(sizes)], schema=index_schema
                    )
                )
                writer.add(ended)
                n_docs += len(sizes)
                n_tokens += len(ended)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            row = [[part], [f"{folder}/{name}"], [n_docs], [n_tokens], [writer.sequences]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                names=["part", "path", "docs", "tokens", "sequences"],
            )

    return pinned(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST))


def read_documents(spark: SparkSession, manifest: DataFrame, id_type: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``part``."""
    # One row per file, far fewer than documents.
    based = manifest.withColumn(
        "base",
        F.coalesce(
            F.sum("tokens").over(
                Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).select("part", "path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = file_system(row["path"] + ".index.arrow")
                with system.open_input_file(place) as source:
                    index = ipc.open_file(source).read_all()
                ends = (
                    index["start"].to_numpy() + index["n_tokens"].to_numpy()
                ).tolist()
                sums = np.zeros(len(ends), np.int64)
                doc = at = crc = 0
                for ids in TokenFile(row["path"] + ".arrow").batches():
                    ids = ids.astype("<u4")
                    last = at + len(ids)
                    begin = at
                    while doc < len(ends) and ends[doc] <= last:
                        sums[doc] = zlib.crc32(ids[begin - at : ends[doc] - at].data, crc)
                        begin, crc, doc = ends[doc], 0, doc + 1
                    if doc < len(ends):
                        crc = zlib.crc32(ids[begin - at :].data, crc)
                    at = last
                yield pa.record_batch(
                    [
                        index["doc_id"].combine_chunks(),
                        pa.array(index["start"].to_numpy() + row["base"]),
                        index["n_tokens"].combine_chunks(),
                        pa.array(sums),
                        pa.array(np.full(len(sums), row["part"], np.int32)),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )

    files = manifest.count()
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, part int"
    return based.repartition(max(1, files), "part").mapInArrow(read, schema)


def token_index(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = SEQUENCE
) -> DataFrame:
    """Writes the tokens of ``docs`` and reads the index back from the files.

    One row per row of ``docs``: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` (with the end id), ``ids_crc32`` (of the ids as little-endian 32-bit numbers) and
    ``part`` (number of the file). The content of an added token, as ``<|endoftext|>``, in a text is
    that token's id, as it is by default of the library. Null and empty texts are an end id alone. Repeated rows follow
    each other. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "tokens")
    manifest = write_tokens(docs, tokenizer_path, folder, length)
    return read_documents(spark, manifest, docs.schema["doc_id"].dataType.simpleString())
