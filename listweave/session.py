"""Session settings and the shared folder for checkpoints and run tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("listweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive times in payloads mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


# Sub-folder of the shared folder that new folders go to, as set by ``scratch``.
_scratch: list[str] = []


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return "/".join([shared_dir(spark), *_scratch[-1:], f"{purpose}-{uuid.uuid4().hex}"])


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """A folder for all that is pinned within the block. It is removed at the end, so results must
    be written by then; with ``keep`` that is left to the caller."""
    name = f"scratch-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    _scratch.append(name)
    try:
        yield folder
    finally:
        _scratch.remove(name)
        if not keep:
            remove_folder(spark, folder)


#: Rows of a few numbers that are worth a task and a file of their own.
ROWS_A_FILE = 100_000


def pinned(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder.

    Cuts the lineage: a lost executor costs no recomputation, values that depend on partitioning
    stay what they were, and the optimizer knows the size from the files. With ``most_rows``, a
    bound on the narrow rows there can be, small tables get few files: on a local file system
    without Hadoop's own library each file starts ``chmod``, a child that for a moment counts with
    all the memory of the executor.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most_rows // ROWS_A_FILE)))
    folder = run_folder(spark, "pinned")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
