"""Landed pages as a data source: one file per page, as fetchers write them.

A page lies in ``source/query/time of fetch/`` under a name with its place among the queries, origin,
number and digest, so a fetcher needs no table format and a page that lands twice is one file.
Filters on source, query and time of fetch decide which folders are listed at all, and files are put
together to parts of about equal bytes, which is what parsing asks for.

    register(spark)
    pages = spark.read.format("landed_pages").load("…/landing").filter("query = 'spark'")
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from listweave.schemas import RAW_PAGES

# The code of this module travels with the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a part, and files of a batch.
PART_BYTES = 4 << 20
BATCH_FILES = 64
NULL = "~"
TIME = "%Y%m%dT%H%M%S.%f"
#: What Hadoop calls file systems, and what Arrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}
COLUMNS = pa.schema(
    [
        ("source", pa.string()),
        ("query", pa.string()),
        ("query_pos", pa.int32()),
        ("origin", pa.string()),
        ("page_no", pa.int32()),
        ("payload", pa.string()),
        ("fetched_at", pa.timestamp("us", tz="UTC")),
    ]
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    scheme, found, rest = uri.partition("://")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def name_of(value: str | int | None) -> str:
    """A value as part of a file name, without the characters that part names."""
    if value is None:
        return NULL
    return quote(str(value), safe="").replace("_", "%5F").replace("~", "%7E").replace(".", "%2E")


def value_of(name: str) -> str | None:
    return None if name == NULL else unquote(name)


def time_name(moment: datetime | None) -> str:
    return NULL if moment is None else in_utc(moment).strftime(TIME)


def time_of(name: str) -> datetime | None:
    return None if name == NULL else datetime.strptime(name, TIME).replace(tzinfo=timezone.utc)


def in_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


TESTS = {
    EqualTo: lambda value, wanted: value == wanted,
    EqualNullSafe: lambda value, wanted: value == wanted,
    GreaterThan: lambda value, wanted: value > wanted,
    GreaterThanOrEqual: lambda value, wanted: value >= wanted,
    LessThan: lambda value, wanted: value < wanted,
    LessThanOrEqual: lambda value, wanted: value <= wanted,
    In: lambda value, wanted: value in wanted,
}


def may_match(test: Filter, value) -> bool:
    """Whether a folder with this value can hold rows that pass; Spark tests the rows again."""

    def plain(wanted):
        return in_utc(wanted) if isinstance(wanted, datetime) else wanted

    if isinstance(test, EqualNullSafe) and test.value is None:
        return value is None
    wanted = tuple(map(plain, test.value)) if isinstance(test, In) else plain(test.value)
    return value is not None and wanted is not None and TESTS[type(test)](value, wanted)


class LandedPart(InputPartition):
    def __init__(self, files: list[tuple[str, tuple]]) -> None:
        super().__init__(None)
        self.files = files


class LandedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.tests: dict[str, list[Filter]] = {"source": [], "query": [], "fetched_at": []}

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:  # noqa: N802
        """Takes tests of folders; all filters are left to be tested by Spark on the rows, too."""
        for test in filters:
            column = getattr(test, "attribute", None)
            if type(test) in TESTS and column is not None and column[0] in self.tests:
                self.tests[column[0]].append(test)
        return filters

    def _folders(self, system: fs.FileSystem, folder: str, column: str, read) -> list[tuple[str, object]]:
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        named = [(f.path, read(f.base_name)) for f in found if f.type == fs.FileType.Directory]
        tests = self.tests[column]
        return sorted((p, v) for p, v in named if all(may_match(t, v) for t in tests))

    def partitions(self) -> list[LandedPart]:
        system, root = file_system(self.path)
        parts: list[list[tuple[str, tuple]]] = []
        size = PART_BYTES
        for source_folder, source in self._folders(system, root, "source", value_of):
            for query_folder, query in self._folders(system, source_folder, "query", value_of):
                for folder, moment in self._folders(system, query_folder, "fetched_at", time_of):
                    infos = system.get_file_info(fs.FileSelector(folder))
                    for info in sorted(infos, key=lambda i: i.path):
                        names = info.base_name.split("_")
                        if info.type != fs.FileType.File or len(names) != 4:
                            continue
                        place, origin, number = map(value_of, names[:3])
                        key = (source, query, place, origin, number, moment)
                        if size + info.size > PART_BYTES:
                            parts.append([])
                            size = 0
                        parts[-1].append((info.path, key))
                        size += info.size
        return [LandedPart(files) for files in parts]

    def read(self, partition: LandedPart | None) -> Iterator[pa.RecordBatch]:
        """Pages of a part; without any part there is a task all the same."""
        system, _ = file_system(self.path)
        files = partition.files if partition is not None else []
        for at in range(0, len(files), BATCH_FILES):
            rows = []
            for path, (source, query, place, origin, number, moment) in files[at : at + BATCH_FILES]:
                with system.open_input_file(path) as file:
                    text = file.read().decode("utf-8", "replace")
                numbers = [None if n is None else int(n) for n in (place, number)]
                rows.append((source, query, numbers[0], origin, numbers[1], text, moment))
            columns = [
                pa.array(column, field.type)
                for column, field in zip(zip(*rows, strict=True), COLUMNS, strict=True)
            ]
            yield pa.record_batch(columns, schema=COLUMNS)


class LandedWriter(DataSourceArrowWriter):
    """Files appear under their names when they are whole; a page that is written again by a
    repeated task takes its own place."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        made: set[str] = set()
        for batch in iterator:
            for row in batch.to_pylist():
                payload = (row["payload"] or "").encode()
                folder = "/".join(
                    [root, name_of(row["source"]), name_of(row["query"]), time_name(row["fetched_at"])]
                )
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                name = "_".join(
                    [*(name_of(row[c]) for c in ("query_pos", "origin", "page_no")),
                     f"{zlib.crc32(payload):08x}{len(payload):x}"]
                )
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as file:
                    file.write(payload)
                system.move(draft, f"{folder}/{name}")
        return WriterCommitMessage()


class LandedPages(DataSource):
    """``load`` and ``save`` take the folder of the landing zone. Pages without payload are empty."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return RAW_PAGES

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LandedWriter:
        if overwrite:
            raise ValueError("landed pages are only added to")
        return LandedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes ``landed_pages`` known to the session, with filters that reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
