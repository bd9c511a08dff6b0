"""The store and its counters on the tables, in one go and as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from listweave.catalog.base import iso_text, query, table
from listweave.catalog.payloads import in_envelope, paged
from listweave.functions import times
from listweave.operators import incremental
from listweave.operators.arrival import consumed_pages, first_seen
from listweave.plans.job_run import collect_jobs, ends_fetch, is_exempt
from listweave.schemas import JOB_SOURCE, RAW_PAGES
from listweave.session import pinned, run_folder
from listweave.sources.store import Store, stored_keys
from listweave.streaming.fetches import WholeFetch
from listweave.streaming.incremental import deduplicated_within, start_incremental, take_open

COUNTS_SQL = """
    WITH stored AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-04-01'),
    fetched AS (
      SELECT o_orderpriority, o_custkey, min(o_orderkey) AS place FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-04-01' GROUP BY ALL),
    flagged AS (
      SELECT *, o_custkey NOT IN (SELECT o_custkey FROM stored)
                AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, place) = 1
                AS is_new
      FROM fetched)
    SELECT o_orderpriority AS query, count(*) AS fetched,
           count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS skipped
    FROM flagged GROUP BY o_orderpriority
"""


def _counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("query"),
        F.col("o_custkey").cast("string").alias("job_id"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_orderdate") < F.lit("1995-04-01").cast("timestamp_ntz")).alias("before"),
    )
    stored = stored_keys(orders.filter("before"), "job_id")
    batch = first_seen(orders.filter("not before").drop("before"), ["query", "job_id"], ["pos"])
    arrival = ["query", "pos"]
    new = incremental.unseen(
        incremental.first_writer(batch, "job_id", arrival), stored, "job_id", arrival
    )
    return incremental.query_counts(batch, new)


@query(COUNTS_SQL)
def incremental_append(spark, sf_dir):
    """Customers of earlier orders are stored; the later orders of each priority are the run."""
    return _counts(spark, sf_dir)


@query(
    f"""
    WITH counts AS ({COUNTS_SQL})
    SELECT CASE WHEN grouping(query) = 1 THEN '(all)' ELSE query END AS query,
           CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(new) AS BIGINT) AS new,
           CAST(sum(skipped) AS BIGINT) AS skipped
    FROM counts GROUP BY ROLLUP (query)
    """
)
def run_summary(spark, sf_dir):
    return incremental.run_totals(_counts(spark, sf_dir))


@query(
    """
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS job_id FROM orders WHERE o_orderstatus = 'F'
    """
)
def store_ids(spark, sf_dir):
    """Distinct keys; null and empty ones are none."""
    status = F.col("o_orderstatus")
    key = F.when(status == "F", F.col("o_custkey").cast("string")).when(status == "O", "")
    stored = table(spark, sf_dir, "orders").select(key.alias("job_id"))
    return stored_keys(stored, "job_id").distinct()


EVENT_FIELDS = ["job_id", "title", "client"]


def _event_listings(batch):
    items = batch.select(
        F.concat_ws("-", "event_type", "user_id").alias("job_id"),
        F.col("event_type").alias("title"),
        F.col("user_id").cast("string").alias("client"),
        F.col("event_type").alias("query"),
        F.col("event_id").alias("pos"),
    )
    return first_seen(items, ["query", "job_id"], ["pos"])


def _text_record(names):
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


@query(
    """
    WITH keyed AS (
      SELECT event_type || '-' || user_id AS job_id, event_type AS title,
             CAST(user_id AS VARCHAR) AS client, event_id % 4 AS part
      FROM events),
    -- The first stream lands parts 0 and 1, then 2; the second one 1 and 2, then 3.
    firsts AS (
      SELECT job_id, title, client,
             min(CASE part WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END) AS pass
      FROM keyed GROUP BY ALL)
    SELECT job_id, title, client, CAST(pass AS BIGINT) AS pass FROM firsts
    """
)
def stream_incremental(spark, sf_dir):
    """Overlapping parts of the events as two file streams in two passes each into one store;
    ``pass`` is the pass that stored a record."""
    events = table(spark, sf_dir, "events")
    store = Store(run_folder(spark, "store"), _text_record(EVENT_FIELDS))
    stored_by = None
    for number, (stream, parts) in enumerate([(0, [0, 1]), (0, [2]), (1, [1, 2]), (1, [3])], 1):
        if number % 2:
            landed, checkpoint = run_folder(spark, "landed"), run_folder(spark, "stream")
        part = events.filter((F.col("event_id") % 4).isin(parts))
        part.write.mode("append").parquet(landed)
        start_incremental(
            spark.readStream.schema(events.schema).parquet(landed),
            _event_listings,
            store,
            checkpoint,
            ["query", "pos"],
        ).awaitTermination()
        now = store.read(spark).select(*EVENT_FIELDS, "run_id")
        if stored_by is not None:
            now = now.join(stored_by.select("run_id").distinct(), "run_id", "left_anti")
        new = pinned(now.withColumn("pass", F.lit(number).cast("bigint")))
        stored_by = new if stored_by is None else stored_by.unionByName(new)
    return store.read(spark).join(
        stored_by.select("job_id", "pass"), "job_id"
    ).select(*EVENT_FIELDS, "pass")


FETCH_PAGE = 60


def _landed_fetches(events):
    """Two fetches of each feed, of the lower and the upper half of the event numbers, as API pages
    of 500 event numbers. A fetch ends at its first page with fewer than 60 items."""
    halves = events.withColumn("fetch", (F.col("event_id") % 2).cast("int"))
    inner = F.struct(
        F.lit("").alias("ciphertext"),
        iso_text(F.col("ts").cast("timestamp")).alias("publishTime"),
    )
    job = F.struct(
        F.concat_ws("-", "event_type", "user_id").alias("id"),
        F.col("event_id").cast("string").alias("title"),
        F.struct(inner.alias("job")).alias("jobTile"),
    )
    group = ("event_type", "fetch")
    pages = paged(halves.select(*group, "event_id", job.alias("job")), "event_id", 1000, group)
    sized = pages.withColumn("n_items", F.size("jobs"))
    landed = consumed_pages(sized, list(group), "page_no", "n_items", FETCH_PAGE)
    return landed.select(
        F.lit(JOB_SOURCE).alias("source"),
        F.col("event_type").alias("query"),
        F.length("event_type").alias("query_pos"),
        F.lit("api").alias("origin"),
        F.col("page_no").cast("int").alias("page_no"),
        in_envelope(F.col("jobs")).alias("payload"),
        (F.lit(datetime(2024, 2, 1)).cast("timestamp") + F.make_interval(hours="fetch")).alias(
            "fetched_at"
        ),
    )


@query(
    """
    WITH items AS (
      SELECT event_type, event_id % 2 AS half, event_id // 1000 AS page_no, event_id,
             event_type || '-' || user_id AS job_id
      FROM events),
    ends AS (
      SELECT event_type, half, min(page_no) AS last_page FROM (
        SELECT event_type, half, page_no, count(*) AS n FROM items GROUP BY ALL)
      WHERE n < 60 GROUP BY ALL),
    landed AS (
      SELECT items.* FROM items LEFT JOIN ends USING (event_type, half)
      WHERE page_no <= coalesce(last_page, page_no)),
    firsts AS (
      SELECT half, event_type, job_id, event_id,
             row_number() OVER (PARTITION BY event_type, job_id ORDER BY half, event_id) AS nth
      FROM landed)
    SELECT job_id, CAST(event_id AS VARCHAR) AS title FROM firsts WHERE nth = 1
    """
)
def stream_fetches(spark, sf_dir):
    """Fetches whose pages fall into several batches. Each of three files has a third of the pages
    of both fetches of every feed, and a batch takes one file."""
    landed = run_folder(spark, "landed")
    pages = _landed_fetches(table(spark, sf_dir, "events"))
    pages.repartition(3, F.col("page_no") % 3).write.parquet(landed)
    store = Store(run_folder(spark, "store"), _text_record(["job_id", "title"]))
    checkpoint = run_folder(spark, "stream")

    def listings(found):
        return collect_jobs(found, None, None, datetime(2024, 2, 1), page_size=FETCH_PAGE)

    stream = spark.readStream.schema(RAW_PAGES).option("maxFilesPerTrigger", 1).parquet(landed)
    whole = WholeFetch(ends_fetch(FETCH_PAGE), exempt=is_exempt())
    place = ["query_pos", "rank"]
    start_incremental(
        stream, listings, store, checkpoint, place, whole=whole
    ).awaitTermination()
    take_open(spark.createDataFrame([], RAW_PAGES), listings, store, checkpoint, place)
    return store.read(spark).select("job_id", "title")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Events as a stream, each key once within a horizon that covers them all."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    out = run_folder(spark, "deduplicated")
    (
        deduplicated_within(timed, ["event_type", "user_id"], "at", "400 days")
        .select("event_type", "user_id")
        .writeStream.format("parquet")
        .option("checkpointLocation", run_folder(spark, "stream"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema("event_type string, user_id bigint").parquet(out)


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS job_id, coalesce(source, '') AS title,
           coalesce(text, '') AS description
    FROM documents
    """
)
def csv_round_trip(spark, sf_dir):
    """Whole texts with quotes, commas and line breaks through a CSV store."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.lit("q").alias("query"),
    )
    record = _text_record(["job_id", "title", "description"])
    store = Store(run_folder(spark, "csv"), record, format="csv")
    store.append_new(documents, "r1", ["job_id"])
    return store.read(spark).drop("run_id")


@query(
    """
    SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS title,
           CASE WHEN value < 20 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END
             AS publish_time
    FROM events
    WHERE value < 20 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-25'
    """
)
def store_newer(spark, sf_dir):
    """Recent records of a store of four runs, of which three were merged in order of time."""
    published = F.when(F.col("value") < 20, "soon").otherwise(iso_text("ts"))
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("job_id"),
        F.col("event_type").alias("title"),
        published.alias("publish_time"),
        F.col("event_type").alias("query"),
        F.col("event_id").alias("pos"),
    )
    record = _text_record(["job_id", "title", "publish_time"])
    store = Store(run_folder(spark, "store"), record, time="publish_time", facets=("title",))
    for run in range(4):
        part = events.filter(F.col("pos") % 4 == run)
        store.append_new(part, f"r{run}", ["pos"])
        if run == 2:
            store.compacted(spark)
    return store.newer(spark, datetime(2024, 1, 30), 5).drop("run_id")


@query("SELECT event_type, event_id, 'ok ' || event_type AS title, true AS in_form FROM events")
def ingest_stamps(spark, sf_dir):
    """Records of a run with their stamp. Its value is the time of the run, so only its form can be
    compared, and that all records of a run have the same one."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+]00:00$"
    stamped = table(spark, sf_dir, "events").select(
        "event_type",
        "event_id",
        F.concat(F.lit("ok "), "event_type").alias("title"),
        times.ingest_stamp().alias("scraped_at"),
    )
    return stamped.select(
        "event_type", "event_id", "title", F.col("scraped_at").rlike(form).alias("in_form")
    )
