"""From raw documents to shards: select, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from listweave.llm import decontam, mixing, quality, sharding, simhash
from listweave.llm.queries import table
from listweave.session import remove_folder, run_folder, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


#: Folders of intermediate tables, by application, data folder and stage, of stages called alone.
_used: dict[tuple[str, str, str], list[str]] = defaultdict(list)


def tidy(stage: Stage) -> Stage:
    """The stage for calls on its own, with its intermediate tables in a folder of their own. They
    stay until the next stage of ``STAGES`` is called on the same data folder, so what the stage
    returned must be written by then. ``run`` does without: it writes every result itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [s.__name__ for _, s in STAGES]
        place = names.index(stage.__name__)
        here = (spark.sparkContext.applicationId, sf_dir)
        before = _used[(*here, names[place - 1])] if place else []
        while before:
            remove_folder(spark, before.pop())
        with scratch(spark, keep=True) as folder:
            _used[(*here, stage.__name__)].append(folder)
            return stage(spark, docs, sf_dir)

    return run_stage


@tidy
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps, with all their columns.

    Null and empty texts and those without words go; rows that tie with the last one that stays
    stay, too; repeated rows share text and id and so their decision; null ids match no label. Without
    labelled good text all rows with words stay. An empty table stays empty.
    """
    return quality.quality_documents(docs, table(spark, sf_dir, "labels"))


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of equal ids one
    row. Null, empty and wordless texts have fingerprint zero and are a group like any other; rows
    without an id come after those with one. An empty table stays empty.
    """
    return simhash.simhash_documents(docs, shingle=3, radius=3)


@tidy
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the benchmark passages in their texts. Null and empty texts and those
    without a passage stay as they are, as do all if the benchmark is empty; repeated rows are cut
    alike; a document that is all passage stays with an empty text.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none above three times. Null sources are a source
    of their own, null texts have no words and are taken or not, repeated rows and null ids count as
    rows of their own. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


@tidy
def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document. Null texts count as no bytes, repeated rows, among them
    those the mix took more than once, have a place each, and null ids are hashed like a value of
    their own. An empty table gives no rows.
    """
    return sharding.sharded(docs, shards=40)


STAGES: list[tuple[str, Stage]] = [
    ("quality", select_quality),
    ("simhash", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over all that the one before it kept, written in between.

    Each call works in folders of its own. Intermediate tables of a stage go once its result is
    written, and that goes once the next one is. What the returned rows are read from stays: the
    documents after mixing and the tables of the last stage, in the folder that ``scratch`` has set
    (``written`` removes them itself).
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        folder = run_folder(spark, name)
        with scratch(spark):
            result = stage.__wrapped__(spark, docs, sf_dir)
            result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
        if before is not None:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)


def written(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The rows of :func:`run` as a table in ``folder``; nothing else stays."""
    with scratch(spark):
        result = run(spark, sf_dir)
        result.write.parquet(folder)
    return spark.read.schema(result.schema).parquet(folder)
