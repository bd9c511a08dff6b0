"""Whole runs over landed pages that Spark makes from the events.

Each event type is a query, an event is a job, and the events of a number range are a page.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listweave.catalog.base import iso_text, query, table
from listweave.catalog.payloads import in_envelope, paged
from listweave.functions import html
from listweave.plans import board_run as board_plan, job_run as job_plan  # noqa: F401  register
from listweave.schemas import BOARD_LISTING, BOARD_SOURCE, JOB_SOURCE
from listweave.session import pinned, run_folder
from listweave.sources import landed
from listweave.sources.html_pages import card_items, card_pages, parsed_details
from listweave.sources.json_pages import api_jobs
from listweave.sources.registry import source
from listweave.sources.store import Store
from listweave.streaming.details import retry_open, start_details

EVENTS_PER_PAGE = 500
EVENTS_PER_CARD_PAGE = 250


def landed_again(pages):
    """The pages of one fetch, a third of them landed twice, and first pages fetched once more."""
    once = pages.withColumn("fetched_at", F.lit(datetime(2024, 2, 1)).cast("timestamp"))
    twice = once.unionByName(once.filter(F.col("page_no") % 3 == 0))
    later = F.col("fetched_at") + F.expr("INTERVAL 1 HOUR")
    return twice.unionByName(
        once.filter(F.col("page_no") == 0).withColumn("fetched_at", later)
    )


def _with_job_fields(events):
    """Newest first: a minute older with every event."""
    first_second = F.lit(datetime(2024, 2, 1)).cast("timestamp").cast("bigint")
    k = F.get_json_object("props", "$.k")
    return events.select(
        "event_type",
        "event_id",
        "value",
        F.concat_ws("-", "user_id", k).alias("id"),
        F.concat(F.lit("~02"), k, F.lit("x"), F.floor(F.col("value") / 10)).alias("cipher"),
        F.when(F.col("value") < 20, "unknown")
        .otherwise(
            iso_text(F.timestamp_seconds(first_second - F.col("event_id") * 60))
        )
        .alias("published"),
    )


def landed_json(spark, sf_dir):
    """API pages of every feed, and page-state pages that repeat the jobs of high value."""
    events = _with_job_fields(table(spark, sf_dir, "events"))
    value, number = F.col("value"), F.floor("value").cast("string")
    inner = F.struct(
        F.col("cipher").alias("ciphertext"),
        F.when(value < 100, "HOURLY").otherwise("FIXED").alias("jobType"),
        F.floor("value").alias("hourlyBudgetMin"),
        F.struct(F.floor("value").alias("amount")).alias("fixedPriceAmount"),
        F.col("published").alias("publishTime"),
    )
    api_job = F.struct(
        "id", F.col("event_type").alias("title"), F.struct(inner.alias("job")).alias("jobTile")
    )
    state_job = F.struct(
        F.when(value < 250, F.col("id")).alias("uid"),
        F.when(value < 300, F.col("cipher")).alias("ciphertext"),
        F.concat(F.lit("state "), "event_type").alias("title"),
        F.lit("recently").alias("createdOn"),
        F.lit(2).alias("type"),
        F.struct(number.alias("amount")).alias("amount"),
        F.lit("1 to 3 months").alias("durationLabel"),
    )

    def landed(jobs, origin: str, payload):
        pages = paged(jobs, "event_id", EVENTS_PER_PAGE, ("event_type",))
        return pages.select(
            F.col("event_type").alias("query"),
            F.length("event_type").alias("query_pos"),
            F.lit(origin).alias("origin"),
            F.col("page_no").cast("int").alias("page_no"),
            payload.alias("payload"),
        )

    rich = events.filter(value >= 200)
    state = rich.select("event_type", "event_id", state_job.alias("job"))
    api = events.select("event_type", "event_id", api_job.alias("job"))
    return landed(state, "state", F.to_json("jobs")).unionByName(
        landed(api, "api", in_envelope(F.col("jobs")))
    )


JOB_RUN_SQL = """
    WITH jobs AS (
      SELECT event_type, event_id, event_id // 500 AS page_no, value,
             user_id || '-' || (props ->> '$.k') AS id,
             '~02' || (props ->> '$.k') || 'x' || CAST(floor(value / 10) AS BIGINT) AS cipher,
             TIMESTAMP '2024-02-01' - to_minutes(event_id) AS moment,
             CASE WHEN value < 20 THEN 'unknown' ELSE strftime(moment, '%Y-%m-%dT%H:%M:%S') END
               AS published
      FROM events),
    ends AS (
      SELECT event_type, min(page_no) AS last_page FROM (
        SELECT event_type, page_no, count(*) AS n FROM jobs GROUP BY ALL) WHERE n < 75 GROUP BY ALL),
    items AS (
      SELECT 0 AS branch, *,
             CASE WHEN value < 250 THEN id WHEN value < 300 THEN cipher ELSE '' END AS a, a AS b,
             CASE WHEN value < 300 THEN cipher ELSE '' END AS link
      FROM jobs WHERE value >= 200 AND a <> ''
      UNION ALL
      SELECT 1, jobs.*, id, substr(cipher, 3), cipher
      FROM jobs LEFT JOIN ends USING (event_type) WHERE page_no <= coalesce(last_page, page_no)),
    folded AS (
      SELECT event_type,
             list_reduce(list([a, b] ORDER BY branch, event_id),
                         lambda seen, pair: CASE WHEN list_contains(seen, pair[1])
                                                   OR list_contains(seen, pair[2]) THEN seen
                                                 ELSE list_concat(seen, pair) END,
                         CAST([] AS VARCHAR[])) AS taken
      FROM items GROUP BY event_type),
    pairs AS (
      SELECT event_type, taken[2 * i + 1] AS a, taken[2 * i + 2] AS b
      FROM (SELECT event_type, taken, unnest(range(len(taken) // 2)) AS i FROM folded)),
    kept AS (
      SELECT * FROM items SEMI JOIN pairs USING (event_type, a, b)
      QUALIFY row_number() OVER (PARTITION BY event_type, a, b ORDER BY branch, event_id) = 1),
    ranked AS (
      SELECT *, row_number() OVER w AS rank,
             max(CAST(branch = 1 AND value >= 20 AND moment < TIMESTAMP '2024-01-26' AS INT))
               OVER w AS stopped
      FROM kept
      WINDOW w AS (PARTITION BY event_type ORDER BY branch, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_type AS query, rank, a AS job_id,
           CASE branch WHEN 0 THEN 'state ' ELSE '' END || event_type AS title,
           CASE WHEN branch = 1 AND value < 100
                THEN '$' || CAST(floor(value) AS BIGINT) || '-$?/hr'
                ELSE '$' || CAST(floor(value) AS BIGINT) END AS budget,
           CASE branch WHEN 0 THEN 'recently' ELSE published END AS publish_time,
           CASE link WHEN '' THEN 'N/A' ELSE 'https://www.upwork.com/jobs/' || link END AS url,
           CASE branch WHEN 0 THEN '1 to 3 months' ELSE 'N/A' END AS duration
    FROM ranked WHERE rank <= 900 AND stopped = 0
"""


@query(JOB_RUN_SQL)
def job_run(spark, sf_dir):
    """Both origins, short pages, two keys, cutoff and cap, then the records."""
    records = source(JOB_SOURCE)(
        landed_again(landed_json(spark, sf_dir)),
        count=900,
        days=6,
        as_of=datetime(2024, 2, 1),
        page_size=75,
        stamp=F.lit(""),
    )
    return records.select(
        "query", "rank", "job_id", "title", "budget", "publish_time", "url", "duration"
    )


@query(
    """
    WITH jobs AS (SELECT event_type, event_id // 500 AS page_no, event_id, value FROM events)
    SELECT event_type AS query, CAST(page_no AS INTEGER) AS page_no, count(*) AS n_jobs,
           CAST(count(*) FILTER (value >= 20) AS BIGINT) AS n_dated
    FROM jobs WHERE event_type IN ('click', 'signup') GROUP BY ALL
    """
)
def landed_source(spark, sf_dir):
    """API pages of two feeds, out of a landing zone with a file per page; the other feeds' folders
    are not listed."""
    landed.register(spark)
    folder = run_folder(spark, "landing")
    pages = landed_json(spark, sf_dir).filter("origin = 'api'").select(
        F.lit(JOB_SOURCE).alias("source"),
        "query",
        "query_pos",
        "origin",
        "page_no",
        "payload",
        F.lit(datetime(2024, 2, 1)).cast("timestamp").alias("fetched_at"),
    )
    pages.write.format("landed_pages").mode("append").save(folder)
    read = spark.read.format("landed_pages").load(folder)
    jobs = api_jobs(read.filter(F.col("query").isin("click", "signup")))
    published = F.col("job.jobTile.job.publishTime")
    return jobs.groupBy("query", "page_no").agg(
        F.count("*").alias("n_jobs"), F.count_if(published != "unknown").alias("n_dated")
    )


def landed_cards(spark, sf_dir):
    """Search pages of cards: entities, nested markup, list items without a card."""
    events = table(spark, sf_dir, "events")
    day = F.when(F.col("value") < 20, "").otherwise(
        F.date_format(F.date_sub(F.lit("2024-02-01").cast("date"),
                                 F.floor(F.col("event_id") / 1000).cast("int")), "yyyy-MM-dd")
    )
    k = F.get_json_object("props", "$.k")
    key = F.concat_ws("", "user_id", F.lit("0"), k)
    card = F.concat(
        F.lit(f'<li class="x"><div class="base-card" {html.CARD_KEY}="urn:li:jobPosting:'),
        key,
        F.lit(f'"><a class="wide {html.CARD_LINK[0]}" href="https://example.org/view/'),
        key,
        F.lit(f'?ref=a&amp;b=1"><span>open</span></a><br><h3 class="{html.CARD_TITLE[0]}">\n '),
        "event_type",
        F.lit(f' &amp; <b> Co </b>\n</h3><h4 class="{html.CARD_COMPANY[0]}"> <a>User &lt;'),
        "user_id",
        F.lit(f'&gt;</a></h4><span class="{html.CARD_LOCATION[0]}">Zone '),
        k,
        F.lit('</span><script>var t="</h3>";</script><time datetime="'),
        day,
        F.lit('">new</time></div></li><li>ad</li>'),
    )
    jobs = events.select("event_type", "event_id", card.alias("job"))
    pages = paged(jobs, "event_id", EVENTS_PER_CARD_PAGE, ("event_type",))
    return pages.select(
        F.col("event_type").alias("query"),
        F.length("event_type").alias("query_pos"),
        F.col("page_no").cast("int").alias("page_no"),
        F.concat(F.lit("<ul>"), F.array_join("jobs", "\n"), F.lit("</ul>")).alias("payload"),
    )


def landed_details(spark, sf_dir):
    """Detail pages of the keys that some event reached with a high value."""
    k = F.get_json_object("props", "$.k")
    items = table(spark, sf_dir, "events").filter(F.col("value") >= 30).select(
        F.concat_ws("", "user_id", F.lit("0"), k).alias("job_id"), "user_id", k.alias("k"), "ts"
    )
    reached = items.groupBy("job_id", "user_id", "k").agg(F.max("ts").alias("fetched_at"))

    def criterion(header: str, value) -> list:
        return [
            F.lit(f'<li class="{html.CRITERION[0]}"><h3 class="{html.CRITERION_HEADER[0]}"> {header} '
                  f'</h3><span class="{" ".join(html.CRITERION_VALUE)}">\n'),
            value,
            F.lit("\n</span></li>"),
        ]

    page = F.concat(
        F.lit(f'<div class="{html.DETAIL_TEXT[0]}"> We &amp; you <br><p>'),
        F.repeat(F.concat(F.lit("line "), "k", F.lit("<br/>")), 60),
        F.lit("</div><ul>"),
        *criterion("Seniority level", F.lit("Replaced")),
        *criterion("Employment type", F.concat(F.lit("Type "), "k")),
        *criterion("Seniority level", F.concat(F.lit("Level "), "user_id")),
        *criterion("On-site/Remote", F.lit("Hybrid")),
        F.lit(f'</ul><figcaption class="{html.APPLICANTS[0]}"> Over '),
        "k",
        F.lit(" applicants</figcaption>"),
        F.when(F.length("k") == 2, f'<span class="{html.WORKPLACE[0]}">Remote</span>').otherwise(""),
    )
    return reached.select("job_id", page.alias("payload"), "fetched_at")


BOARD_RUN_SQL = """
    WITH cards AS (
      SELECT event_type, event_id, event_id // 250 AS page_no, value, user_id, props ->> '$.k' AS k,
             user_id || '0' || (props ->> '$.k') AS job_id,
             DATE '2024-02-01' - CAST(event_id // 1000 AS INT) AS day
      FROM events),
    ends AS (
      SELECT event_type, min(page_no) AS last_page FROM (
        SELECT event_type, page_no, count(*) AS n FROM cards GROUP BY ALL) WHERE n < 37 GROUP BY ALL),
    firsts AS (
      SELECT cards.* FROM cards LEFT JOIN ends USING (event_type)
      WHERE page_no <= coalesce(last_page, page_no)
      QUALIFY row_number() OVER (PARTITION BY event_type, job_id ORDER BY event_id) = 1),
    ranked AS (
      SELECT *, row_number() OVER w AS rank,
             max(CAST(value >= 20 AND day < DATE '2024-01-26' AS INT)) OVER w AS stopped
      FROM firsts
      WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    kept AS (SELECT * FROM ranked WHERE rank <= 1350 AND stopped = 0),
    detailed AS (SELECT DISTINCT job_id FROM cards WHERE value >= 30)
    SELECT event_type AS query, rank, job_id, event_type || ' &Co' AS title,
           'User <' || user_id || '>' AS company, 'Zone ' || k AS location,
           CASE WHEN value < 20 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS publish_time,
           'https://example.org/view/' || job_id AS url,
           CASE WHEN d.job_id IS NULL THEN ''
                ELSE left('We & you' || repeat(chr(10) || 'line ' || k, 60), 500) END AS description,
           CASE WHEN d.job_id IS NULL THEN '' ELSE 'Level ' || user_id END AS experience_level,
           CASE WHEN d.job_id IS NULL THEN '' ELSE 'Type ' || k END AS employment_type,
           CASE WHEN d.job_id IS NULL THEN '' WHEN length(k) = 2 THEN 'Remote' ELSE 'Hybrid' END
             AS workplace_type,
           CASE WHEN d.job_id IS NULL THEN '' ELSE 'Over ' || k || ' applicants' END
             AS applicant_count
    FROM kept LEFT JOIN detailed d USING (job_id)
"""


@query(BOARD_RUN_SQL)
def board_run(spark, sf_dir):
    """Cards in HTML, short pages, dedup, cutoff by date and cap, then details of what stays."""
    records = source(BOARD_SOURCE)(
        landed_again(landed_cards(spark, sf_dir)),
        count=1350,
        days=6,
        as_of=datetime(2024, 2, 1, 18),
        raw_details=landed_details(spark, sf_dir),
        page_size=37,
        stamp=F.lit(""),
    )
    return records.drop("query_pos", "source", "skills", "scraped_at")


@query(
    """
    SELECT event_type AS query, event_id // 250 AS page_no,
           row_number() OVER (PARTITION BY event_type, event_id // 250 ORDER BY event_id) - 1 AS pos,
           user_id || '0' || (props ->> '$.k') AS job_id, event_type || ' &Co' AS title,
           'User <' || user_id || '>' AS company, 'Zone ' || (props ->> '$.k') AS location,
           CASE WHEN value < 20 THEN ''
                ELSE strftime(DATE '2024-02-01' - CAST(event_id // 1000 AS INT), '%Y-%m-%d') END
             AS publish_time,
           'https://example.org/view/' || user_id || '0' || (props ->> '$.k') AS url
    FROM events
    """
)
def board_cards(spark, sf_dir):
    """Every card of every search page, as the board run reads them."""
    cards = card_items(card_pages(landed_cards(spark, sf_dir).drop("query_pos")))
    return cards.withColumns({c: F.col(c).cast("bigint") for c in ("page_no", "pos")})


@query(
    """
    SELECT DISTINCT user_id || '0' || k AS job_id,
           left('We & you' || repeat(chr(10) || 'line ' || k, 60), 500) AS description,
           'Level ' || user_id AS experience_level, 'Type ' || k AS employment_type, '' AS skills,
           'Over ' || k || ' applicants' AS applicant_count,
           CASE length(k) WHEN 2 THEN 'Remote' ELSE 'Hybrid' END AS workplace_type
    FROM (SELECT user_id, props ->> '$.k' AS k FROM events WHERE value >= 30)
    """
)
def board_details(spark, sf_dir):
    """Every detail page, as the board run reads them."""
    return parsed_details(landed_details(spark, sf_dir))


DETAIL_COLUMNS = [
    "description", "experience_level", "employment_type", "workplace_type", "applicant_count"
]


@query(
    f"""
    WITH run AS ({BOARD_RUN_SQL})
    SELECT job_id, title, company, location, {", ".join(DETAIL_COLUMNS)} FROM run
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY query, rank) = 1
    """
)
def late_details(spark, sf_dir):
    """The board run without details, while half of the details have landed before its listings are
    stored and the others land afterwards, as a stream of two runs."""
    store = Store(run_folder(spark, "store"), BOARD_LISTING)
    landed, checkpoint = run_folder(spark, "landed"), run_folder(spark, "stream")
    details = pinned(landed_details(spark, sf_dir))

    def land(half: int) -> None:
        some = details.filter(F.pmod(F.xxhash64("job_id"), F.lit(2)) == half)
        some.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(details.schema).parquet(landed)
        start_details(stream, parsed_details, store, checkpoint).awaitTermination()

    land(0)
    listings = source(BOARD_SOURCE)(
        landed_again(landed_cards(spark, sf_dir)),
        count=1350,
        days=6,
        as_of=datetime(2024, 2, 1, 18),
        page_size=37,
        stamp=F.lit(""),
    )
    store.append_new(listings, "listings", ["query", "rank"])
    land(1)
    retry_open(details.limit(0), parsed_details, store, checkpoint)
    return store.read(spark).select("job_id", "title", "company", "location", *DETAIL_COLUMNS)
