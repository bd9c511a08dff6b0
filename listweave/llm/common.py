"""Helpers of several operators: words in Arrow batches, free column names, row numbers."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listweave.session import pinned

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
ALNUM = bytes(
    b
    if b >= 128 or chr(b).isalnum()
    else 32
    for b in LOWER
)


#: Bounds on the batches of texts that go to a Python worker and come back.
BATCH_ROWS = 1_000
BATCH_BYTES = "8m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table; its session sends Python workers small batches from now on, as the default
    of 10,000 rows is too many for long texts. A lower setting stays."""
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a name like it, that no column of ``df`` has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a stored table with a unique number per row, and the name of its column.

    The numbers are written, so they stay the same when a lost executor's work is redone.
    """
    name = fresh(df, "_row")
    return pinned(df.withColumn(name, F.monotonically_increasing_id())), name


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def large_texts(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Texts with null as the empty text; offsets start at zero and the data is theirs alone."""
    texts = pc.fill_null(one_array(column).cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = data.slice(places[0], places[-1] - places[0])
    buffers = [None, pa.py_buffer(places - places[0]), own]
    return pa.Array.from_buffers(texts.type, len(texts), buffers)


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Each byte of the texts replaced by ``table``; ASCII must map to ASCII, the rest to itself."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    mapped = pa.py_buffer(data.to_pybytes().translate(table))
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, mapped], offset=texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between the characters x20 and x09-x0D, and how many each text has."""
    if not len(texts):
        return pa.array([], texts.type), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    kept = real.to_numpy(zero_copy_only=False)
    if not kept.all():
        words, owner = words.filter(real), owner[kept]
    return words, np.bincount(owner, minlength=len(lists))


def ends_of(counts: np.ndarray) -> np.ndarray:
    """Running ends of consecutive runs of these lengths, with a zero in front."""
    return np.concatenate([[0], np.cumsum(counts)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of every run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(lengths.sum())


def lots(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with a bounded number of bytes of text, a longer text on its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    before = np.cumsum(sizes) - sizes
    cuts = [0, *(np.flatnonzero(np.diff(before // most_bytes)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
