"""The store of records: append only, keys never written twice, any number of writers at once.

Each run writes a folder of its own and its keys to the key index, then adds the folder to the list
of versions (``commits``). Readers see listed folders only, so a killed write leaves nothing to be
seen. A writer that finds that another one was faster looks again at what is new. A repeated run
replaces what an earlier attempt left behind.

The key index has the keys of all runs in files by a hash of the key. A batch opens only those that
its own keys may be in, whatever the number of runs. ``Store.compacted`` merges small runs and their
keys, into as many of those files as the keys ask for.

A CSV store holds texts with line breaks, so its files cannot be split: a file is read by one task.
Take over a single large CSV file by copying it into a Parquet store first (``Store.take_over``). A
store without a list of versions, such as files from elsewhere, is read as it is; its keys are read
from the records until it is compacted.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.functions.times import cutoff_time, iso_timestamp, older_than_time
from listweave.operators.incremental import first_writer, query_counts, unseen
from listweave.operators.spread import null_safe_join
from listweave.session import pinned, remove_folder
from listweave.sources.commits import (
    FEWEST_BUCKETS,
    Commits,
    Part,
    State,
    buckets_of,
    new_index,
)

CSV_WRITE = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_READ = {**CSV_WRITE, "multiLine": "true", "enforceSchema": "true"}

#: The time of a record in the files of merged parts, in microseconds, as Spark writes timestamps in
#: a form without statistics unless it is told otherwise.
TIME = "_time"
#: Keys of a folder of the key index after merging, and how many folders there are at most.
BUCKET_KEYS = 1_000_000
MOST_BUCKETS = 4096
#: Times that a writer starts again because others were faster.
MOST_TRIES = 50


@dataclass(frozen=True)
class Store:
    """Records of one schema under one path, as ``parquet`` or ``csv``.

    ``time`` names a column with ISO times. Merged parts of a Parquet store keep it as a number,
    too, and lie in order of it, so that filters by time skip files and row groups by their
    statistics; ``facets`` are columns for which they have Bloom filters, besides the key.
    """

    path: str
    schema: T.StructType
    key: str = "job_id"
    format: str = "parquet"
    time: str = ""
    facets: tuple[str, ...] = ()

    @property
    def _with_run(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("run_id", T.StringType())])

    @property
    def _with_time(self) -> T.StructType:
        return T.StructType([*self._with_run.fields, T.StructField(TIME, T.LongType())])

    def state(self, spark: SparkSession) -> State:
        return Commits(spark, self.path).latest()

    def read(self, spark: SparkSession, state: State | None = None) -> DataFrame:
        """All records with their ``run_id``, of the newest version unless one is given; none if
        the store does not exist yet."""
        state = self.state(spark) if state is None else state
        of_runs = [p for p in state.parts if p.run is not None]
        tables = [self._records(spark, of_runs)] if of_runs else []
        for part in state.parts:
            if part.run is None:
                tables.append(
                    self._records(spark, [part]).filter(~F.col("run_id").isin(*part.without))
                )
        if not tables:
            return spark.createDataFrame([], self._with_run)
        return reduce(DataFrame.unionByName, tables)

    def _records(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        options = CSV_READ if self.format == "csv" else {}
        reader = spark.read.schema(self._with_run).options(basePath=self.path, **options)
        stored = reader.format(self.format).load([f"{self.path}/{p.folder}" for p in parts])
        return stored.fillna("", subset=self.schema.names) if self.format == "csv" else stored

    def keys(self, spark: SparkSession, but_run: str | None = None) -> DataFrame:
        """Keys that are not empty, with repeats; enough for an anti join."""
        state = self.state(spark)
        return self._known(spark, state, None, but_run)

    def ids(self, spark: SparkSession) -> DataFrame:
        return self.keys(spark).distinct()

    def _known(
        self, spark: SparkSession, state: State, buckets: list[int] | None, but_run: str | None
    ) -> DataFrame:
        """Keys of the store, of some buckets of the index or of all. Parts that are not in the
        index have their keys read from the records."""
        plain = [p for p in state.parts if not p.indexed]
        records = self.read(spark, replace(state, parts=tuple(plain)))
        if but_run is not None:
            records = records.filter(F.col("run_id") != but_run)
        found = stored_keys(records, self.key)
        indexed = [p for p in state.parts if p.indexed and p.run != (but_run or "")]
        index = self._index_of(spark, state, buckets)
        if not indexed or index is None:
            return found
        rows = [(p.name, run) for p in indexed for run in p.without or [None]]
        parts = spark.createDataFrame(rows, "part string, gone string")
        if but_run is not None:
            index = index.filter(~F.col("run").eqNullSafe(but_run))
        listed = index.join(parts.select("part").distinct(), "part", "left_semi")
        gone = parts.filter("gone IS NOT NULL")
        if any(p.without for p in indexed):
            listed = listed.join(gone, (listed.part == gone.part) & (listed.run == gone.gone), "left_anti")
        return found.unionByName(listed.select(F.col("key").alias(self.key)))

    def _index_of(
        self, spark: SparkSession, state: State, buckets: list[int] | None
    ) -> DataFrame | None:
        """The key index, or some buckets of it, with keys of parts that are not listed, too; None if
        there are no files."""
        folder = f"{self.path}/{state.keys}"
        there = [n for n in Commits(spark, self.path).names(folder) if n.startswith("bucket=")]
        if buckets is not None:
            there = [n for n in there if int(n.removeprefix("bucket=")) in set(buckets)]
        if not there:
            return None
        reader = spark.read.schema("key string, run string, part string, bucket int")
        return reader.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in there])

    def take_over(self, old: "Store", spark: SparkSession, run_id: str) -> int:
        """Copies all records of another store into one run of this one."""
        return self.write(old.read(spark), run_id)

    def write(self, records: DataFrame, run_id: str) -> int:
        """Writes the records in schema order as all that there is of a run, whatever their keys,
        and returns how many there were."""
        spark = records.sparkSession
        commits = Commits(spark, self.path)
        state = commits.latest()
        part, rows = self._written(records, run_id, state)
        for _ in range(MOST_TRIES):
            if commits.add(state.with_run(run_id, part)):
                return rows
            now = commits.latest()
            if now.keys != state.keys:
                # The index was written anew in the meantime, so the keys have to go there, too.
                part, rows = self._written(records, run_id, now)
            state = now
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def _written(self, records: DataFrame, run_id: str, state: State) -> tuple[Part, int]:
        """The records and their keys as a part that no version lists yet."""
        name = uuid.uuid4().hex
        part = Part(name, f"run_id={run_id}/{name}", run_id)
        seen = Observation()
        writer = (
            records.select(*self.schema.names)
            .observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.options(**(CSV_WRITE if self.format == "csv" else {}))
        )
        writer.format(self.format).save(f"{self.path}/{part.folder}")
        stored = self._records(records.sparkSession, [part])
        self._index(stored.select(self.key, "run_id"), name, state.keys)
        return part, seen.get["rows"]

    def _index(self, records: DataFrame, name: str, folder: str) -> None:
        """Adds the keys of records to the key index, a file per bucket. The files are written
        aside and then moved, as two jobs cannot write into one folder."""
        keys = records.filter(F.nullif(F.col(self.key), F.lit("")).isNotNull()).select(
            F.col(self.key).alias("key"),
            F.col("run_id").alias("run"),
            F.lit(name).alias("part"),
            _bucket(F.col(self.key), buckets_of(folder)).alias("bucket"),
        )
        aside = f"{self.path}/{folder}/.{name}"
        in_buckets = keys.repartition("bucket").sortWithinPartitions("bucket", "key")
        in_buckets.write.partitionBy("bucket").parquet(aside)
        commits = Commits(keys.sparkSession, self.path)
        for bucket in commits.names(aside):
            if bucket.startswith("bucket="):
                commits.move_files(f"{aside}/{bucket}", f"{self.path}/{folder}/{bucket}", name)
        remove_folder(keys.sparkSession, aside)

    def append_new(
        self, listings: DataFrame, run_id: str, arrival: list[str], query: str = "query"
    ) -> DataFrame:
        """Writes the listings whose key is neither stored nor earlier in the run.

        Returns fetched, new and skipped per query. What is new is decided on keys, arrival and
        query alone; a listing as a whole is moved once. Nothing is written if nothing is new,
        except over what a failed attempt of the same run has left. ``arrival`` is unique in the
        run. If another writer is faster, what is new is decided again.
        """
        spark = listings.sparkSession
        commits = Commits(spark, self.path)
        batch = pinned(listings)
        place = list(dict.fromkeys([*arrival, self.key]))
        names = list(dict.fromkeys([*place, query]))
        firsts = pinned(first_writer(batch.select(*names), self.key, arrival))
        wanted = stored_keys(firsts, self.key)
        for _ in range(MOST_TRIES):
            state = commits.latest()
            known = self._known(spark, state, self._buckets_of(wanted, state), run_id)
            # Few of the stored keys matter to a batch, so they are reduced to its keys first.
            hits = pinned(known.join(wanted, self.key, "left_semi"))
            new = pinned(unseen(firsts, hits, self.key, arrival))
            if not new.isEmpty():
                fresh = null_safe_join(batch, new.select(*place), place, "left_semi")
                part = self._written(fresh, run_id, state)[0]
            elif run_id in state.runs() or any(p.run is None for p in state.parts):
                part = None
            else:
                return query_counts(batch.select(query), new, query)
            if commits.add(state.with_run(run_id, part)):
                return query_counts(batch.select(query), new, query)
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def known(self, wanted: DataFrame) -> DataFrame:
        """Those of the wanted keys that are stored, each once. Few key files are read."""
        spark = wanted.sparkSession
        keys = pinned(stored_keys(wanted, self.key).distinct())
        state = self.state(spark)
        found = self._known(spark, state, self._buckets_of(keys, state), None)
        return found.join(keys, self.key, "left_semi").distinct()

    def _buckets_of(self, keys: DataFrame, state: State) -> list[int]:
        buckets = keys.select(_bucket(F.col(self.key), state.buckets)).distinct()
        return [r[0] for r in buckets.collect()]

    def amended(self, changes: DataFrame) -> None:
        """Writes the columns of ``changes``, a row per key, into the records of those keys, blank
        values aside. The key index names the parts that hold them; only those are written anew, as
        one, and readers see all of the change or none."""
        spark = changes.sparkSession
        commits = Commits(spark, self.path)
        changes = pinned(changes.filter(F.nullif(F.col(self.key), F.lit("")).isNotNull()))
        columns = [c for c in changes.columns if c != self.key]
        new = changes.withColumnsRenamed({c: f"_new_{c}" for c in changes.columns})
        for _ in range(MOST_TRIES):
            state = commits.latest()
            names = self._parts_with(changes, state)
            touched = [p for p in state.parts if not p.indexed or p.name in names]
            if not touched:
                return
            records = self.read(spark, replace(state, parts=tuple(touched)))
            joined = records.join(new, F.col(self.key) == F.col(f"_new_{self.key}"), "left")
            filled = {
                c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)) for c in columns
            }
            amended = joined.withColumns(filled).select(*self._with_run.names)
            part = self._merged(amended, state.keys)
            others = tuple(p for p in state.parts if p not in touched)
            if commits.add(replace(state, parts=(*others, part))):
                return
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def _parts_with(self, changes: DataFrame, state: State) -> set[str]:
        """Names of the parts that the key index has for the keys of ``changes``."""
        spark = changes.sparkSession
        index = self._index_of(spark, state, self._buckets_of(changes, state))
        if index is None:
            return set()
        keys = changes.select(F.col(self.key).alias("key"))
        return {r[0] for r in index.join(keys, "key", "left_semi").select("part").distinct().collect()}

    def _merged(self, records: DataFrame, keys: str, files: int | None = None) -> Part:
        """Records of any runs, with their ``run_id``, as one part that no version lists yet."""
        name = uuid.uuid4().hex
        part = Part(name, f"merged/{name}", None)
        writer = self._clustered(records, files).write
        if self.format == "csv":
            writer = writer.options(**CSV_WRITE)
        else:
            for column in (self.key, *self.facets):
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.format(self.format).save(f"{self.path}/{part.folder}")
        written = self._records(records.sparkSession, [part])
        self._index(written.select(self.key, "run_id"), name, keys)
        return part

    def _clustered(self, records: DataFrame, files: int | None) -> DataFrame:
        """Records for a merged part, with their time and in order of it if the store has one."""
        if self.format == "csv" or not self.time:
            return records if files is None else records.repartition(files)
        timed = records.withColumn(TIME, F.unix_micros(iso_timestamp(F.col(self.time))))
        numbers = [] if files is None else [files]
        return timed.repartitionByRange(*numbers, TIME, self.key).sortWithinPartitions(TIME, self.key)

    def newer(
        self, spark: SparkSession, as_of: datetime, days: int, state: State | None = None
    ) -> DataFrame:
        """The records whose time is not older than ``days`` before ``as_of``; those without a
        readable time are never old. Of merged parts only what may be wanted is read."""
        state = self.state(spark) if state is None else state
        merged = tuple(p for p in state.parts if p.run is None)
        others = self.read(spark, replace(state, parts=tuple(set(state.parts) - set(merged))))
        found = others.filter(~older_than_time(F.col(self.time), as_of, days))
        if not merged or self.format == "csv":
            more = self.read(spark, replace(state, parts=merged))
            return found.unionByName(more.filter(~older_than_time(F.col(self.time), as_of, days)))
        since = cutoff_time(as_of, days) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        cutoff = since // timedelta(microseconds=1)
        for part in merged:
            rows = spark.read.schema(self._with_time).parquet(f"{self.path}/{part.folder}")
            kept = rows.filter(F.col(TIME).isNull() | (F.col(TIME) >= cutoff))
            kept = kept.filter(~F.col("run_id").isin(*part.without)).drop(TIME)
            found = found.unionByName(kept)
        return found

    def compacted(self, spark: SparkSession, files: int = 8) -> None:
        """Merges all parts into one of ``files`` files, and their keys into a new index with a file
        per bucket. Readers and writers may go on; the old files stay until ``vacuumed``."""
        commits = Commits(spark, self.path)
        for _ in range(MOST_TRIES):
            state = commits.latest()
            if not state.parts:
                return
            wanted = -(-self.read(spark, state).count() // BUCKET_KEYS)
            keys = new_index(min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (wanted - 1).bit_length())))
            part = self._merged(self.read(spark, state), keys, files)
            if commits.add(State(state.version, keys, (part,))):
                return
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def vacuumed(self, spark: SparkSession) -> None:
        """Removes the folders that the newest version does not list. No writer may be at work, and
        readers of earlier versions lose theirs."""
        commits = Commits(spark, self.path)
        state = commits.latest()
        used = {p.folder for p in state.parts} | {state.keys}
        for outer in commits.names(self.path):
            if outer.startswith("run_id=") or outer in ("merged", "_keys"):
                if outer in used:
                    continue
                for inner in commits.names(f"{self.path}/{outer}"):
                    if f"{outer}/{inner}" not in used:
                        remove_folder(spark, f"{self.path}/{outer}/{inner}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_keys(stored: DataFrame, key: str) -> DataFrame:
    return stored.select(F.col(key)).filter(F.nullif(F.col(key), F.lit("")).isNotNull())
