"""The list of what a store holds, in versions that follow each other without gaps.

Each version is a small file that is written under another name and then renamed to its number. The
rename fails if the number is taken, so of two writers that go on from the same version one has to
look at the other's work first. What no version lists does not exist for readers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

FOLDER = "_commits"
#: Earlier versions that stay for readers that have just read the list.
KEPT_VERSIONS = 20
#: Folders of a new key index; up to so many are listed without a job.
FEWEST_BUCKETS = 32


def new_index(buckets: int = FEWEST_BUCKETS) -> str:
    """Name of a folder for a key index, which says how many folders it has."""
    return f"_keys/{buckets}-{uuid.uuid4().hex}"


def buckets_of(index: str) -> int:
    return int(index.removeprefix("_keys/").partition("-")[0])


@dataclass(frozen=True)
class Part:
    """A folder with records: of one run, or merged from several, whose ``run_id`` is then a column
    of the files. Rows of the runs in ``without`` no longer count. ``indexed`` parts have their keys
    in the key index under ``name``."""

    name: str
    folder: str
    run: str | None
    indexed: bool = True
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    """What a store holds at a version; version -1 has no file."""

    version: int = -1
    keys: str = field(default_factory=new_index)
    parts: tuple[Part, ...] = field(default=())

    @property
    def buckets(self) -> int:
        return buckets_of(self.keys)

    def runs(self) -> set[str]:
        return {part.run for part in self.parts if part.run is not None}

    def with_run(self, run: str, part: Part | None) -> State:
        """The next state, in which ``part`` is all that there is of the run."""
        others = [p for p in self.parts if p.run != run]
        others = [
            replace(p, without=(*p.without, run)) if p.run is None and run not in p.without else p
            for p in others
        ]
        return replace(self, parts=(*others, *([part] if part else [])))


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.java = spark._jvm.org.apache.hadoop.fs
        self.files = self.java.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names of the files and folders in a folder, none if it does not exist."""
        target = self.java.Path(folder)
        if not self.files.exists(target):
            return []
        return sorted(status.getPath().getName() for status in self.files.listStatus(target))

    def move_files(self, source: str, folder: str, prefix: str) -> None:
        """Moves the files of one folder into another one, under names that begin with ``prefix``."""
        self.files.mkdirs(self.java.Path(folder))
        for name in self.names(source):
            target = self.java.Path(f"{folder}/{prefix}-{name}")
            if not self.files.rename(self.java.Path(f"{source}/{name}"), target):
                raise OSError(f"cannot move {name} to {folder}")

    def _versions(self) -> list[int]:
        names = self.names(f"{self.path}/{FOLDER}")
        return [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]

    def latest(self) -> State:
        """The newest version. Of a store without any, the folders of runs that lie there."""
        versions = self._versions()
        if versions:
            stream = self.files.open(self.java.Path(self._file(versions[-1])))
            try:
                read = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            parts = [Part(**{**p, "without": tuple(p["without"])}) for p in read["parts"]]
            return State(read["version"], read["keys"], tuple(parts))
        runs = [name for name in self.names(self.path) if name.startswith("run_id=")]
        parts = [Part(name, name, name.removeprefix("run_id="), indexed=False) for name in runs]
        return State(-1, new_index(), tuple(parts))

    def _file(self, version: int) -> str:
        return f"{self.path}/{FOLDER}/{version:020d}.json"

    def add(self, state: State) -> bool:
        """Makes ``state`` the version after its own; False if there already is such a version."""
        version = state.version + 1
        body = json.dumps({"version": version, "keys": state.keys, "parts": [asdict(p) for p in state.parts]})
        folder = f"{self.path}/{FOLDER}"
        draft = self.java.Path(f"{folder}/.{uuid.uuid4().hex}.draft")
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        context = self.java.FileContext.getFileContext(
            self.files.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(self.java.Options.Rename, 1)
        options[0] = self.java.Options.Rename.NONE
        try:
            context.rename(draft, self.java.Path(self._file(version)), options)
        except Exception as problem:  # noqa: BLE001
            self.files.delete(draft, False)
            if "FileAlreadyExistsException" in str(problem):
                return False
            raise
        for old in self._versions()[:-KEPT_VERSIONS]:
            self.files.delete(self.java.Path(self._file(old)), False)
        return True
