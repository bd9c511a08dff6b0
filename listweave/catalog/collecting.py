"""Dedup, cutoff, cap, page end and union on the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listweave.catalog.base import iso_text, query, table
from listweave.functions import text, times
from listweave.operators import arrival, grouping
from listweave.operators.spread import running_total
from listweave.operators.twokey import greedy_two_key

FEED = "event_type"


@query(
    """
    WITH firsts AS (
      SELECT event_type, user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts
      FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER w AS rank,
             max(CAST(ts < TIMESTAMP '2024-01-28' AS INT)) OVER w AS stopped
      FROM firsts
      WINDOW w AS (PARTITION BY event_type ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING))
    SELECT event_type, user_id, event_id, rank FROM ranked WHERE rank <= 100 AND stopped = 0
    """
)
def collect_recent(spark, sf_dir):
    """Newest first: dedup by user, stop two days back, at most 100 per feed."""
    old = times.older_than_time(iso_text("ts"), datetime(2024, 1, 30), 2)
    events = (
        table(spark, sf_dir, "events")
        .filter(F.col("user_id").isNotNull())
        .select(FEED, "user_id", (-F.col("event_id")).alias("age"), old.alias("old"))
    )
    unique = arrival.first_seen(events, [FEED, "user_id"], ["age"])
    return arrival.collected(unique, [FEED], "old", ["age"], 100).select(
        FEED, "user_id", (-F.col("age")).alias("event_id"), "rank"
    )


@query(
    """
    WITH firsts AS (
      SELECT * FROM events
      QUALIFY row_number() OVER (
        PARTITION BY event_type, user_id ORDER BY value DESC, event_id) = 1),
    ranked AS (
      SELECT *, row_number() OVER w AS rank,
             max(CAST(ts < TIMESTAMP '2024-01-02' AS INT)) OVER w AS stopped
      FROM firsts
      WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id
                   ROWS UNBOUNDED PRECEDING))
    SELECT event_type, user_id, event_id, rank FROM ranked WHERE rank <= 40 AND stopped = 0
    """
)
def collect_prefix(spark, sf_dir):
    """Arrival that does not follow time: the first old item ends the feed."""
    events = table(spark, sf_dir, "events").select(
        FEED,
        "user_id",
        "event_id",
        (F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).alias("old"),
        (-F.col("value")).alias("below"),
    )
    order = ["below", "event_id"]
    unique = arrival.first_seen(events, [FEED, "user_id"], order)
    return arrival.collected(unique, [FEED], "old", order, 40).select(
        FEED, "user_id", "event_id", "rank"
    )


@query(
    """
    WITH ranked AS (
      SELECT *, row_number() OVER w AS rank,
             max(CAST(o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1995-01-03' AS INT))
               OVER w AS stopped
      FROM orders
      WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
    SELECT o_orderpriority, o_orderkey, rank FROM ranked WHERE rank <= 5000 AND stopped = 0
    """
)
def collect_large_cap(spark, sf_dir):
    """Cutoff and a cap beyond what a pruned window takes."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        (
            (F.col("o_orderstatus") == "P")
            & (F.col("o_orderdate") < F.lit("1995-01-03").cast("timestamp_ntz"))
        ).alias("old"),
    )
    kept = arrival.collected(orders, ["o_orderpriority"], "old", ["o_orderkey"], 5000)
    return kept.select("o_orderpriority", "o_orderkey", "rank")


@query(
    """
    SELECT event_type, user_id, min(event_id) AS event_id,
           strftime(arg_min(ts, event_id), '%Y-%m-%dT%H:%M:%S') AS published,
           arg_min(props, event_id) AS props
    FROM events GROUP BY event_type, user_id
    """
)
def first_seen(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        FEED, "user_id", "event_id", iso_text("ts").alias("published"), "props"
    )
    return arrival.first_seen(events, [FEED, "user_id"], ["event_id"])


@query(
    """
    WITH pairs AS (
      SELECT l_returnflag, l_orderkey AS a, CAST('2' || l_partkey AS BIGINT) AS b,
             min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS place
      FROM lineitem GROUP BY ALL),
    folded AS (
      SELECT l_returnflag,
             list_reduce(list([a, b] ORDER BY place),
                         lambda seen, pair: CASE WHEN list_contains(seen, pair[1])
                                                   OR list_contains(seen, pair[2]) THEN seen
                                                 ELSE list_concat(seen, pair) END,
                         CAST([] AS BIGINT[])) AS taken
      FROM pairs GROUP BY l_returnflag),
    kept AS (
      SELECT l_returnflag, taken[2 * i + 1] AS a, taken[2 * i + 2] AS b
      FROM (SELECT l_returnflag, taken, unnest(range(len(taken) // 2)) AS i FROM folded))
    SELECT l_returnflag, place[1] AS l_orderkey, place[2] AS l_linenumber,
           place[3] AS l_partkey, place[4] AS l_suppkey
    FROM kept JOIN pairs USING (l_returnflag, a, b)
    """
)
def two_key_dedup(spark, sf_dir):
    """Order key and stripped part cipher share one set of seen keys per flag."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        *order,
        F.col("l_orderkey").cast("string").alias("id"),
        text.stripped_cipher(F.concat(F.lit("~02"), "l_partkey")).alias("cipher"),
    )
    kept = greedy_two_key(items, ["l_returnflag"], "id", "cipher", order)
    return kept.select("l_returnflag", *order)


@query(
    """
    WITH pairs AS (
      SELECT o_orderpriority, CAST(o_custkey AS BIGINT) AS a,
             10000000 + (o_custkey + o_orderkey) % 997 AS b, min(o_orderkey) AS place
      FROM orders GROUP BY ALL),
    folded AS (
      SELECT o_orderpriority,
             list_reduce(list([a, b] ORDER BY place),
                         lambda seen, pair: CASE WHEN list_contains(seen, pair[1])
                                                   OR list_contains(seen, pair[2]) THEN seen
                                                 ELSE list_concat(seen, pair) END,
                         CAST([] AS BIGINT[])) AS taken
      FROM pairs GROUP BY o_orderpriority),
    kept AS (
      SELECT o_orderpriority, taken[2 * i + 1] AS a, taken[2 * i + 2] AS b
      FROM (SELECT o_orderpriority, taken, unnest(range(len(taken) // 2)) AS i FROM folded))
    SELECT o_orderpriority, place AS o_orderkey FROM kept JOIN pairs USING (o_orderpriority, a, b)
    """
)
def two_key_turns(spark, sf_dir):
    """Chains of customers and clerks, with limits so low that all ways of settling are taken:
    rounds, salted joins and many slices."""
    items = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer"),
        (10000000 + (F.col("o_custkey") + F.col("o_orderkey")) % 997).cast("string").alias("clerk"),
    )
    kept = greedy_two_key(
        items, ["o_orderpriority"], "customer", "clerk", ["o_orderkey"],
        rounds=2, slice_rows=400, rows_per_salt=20,
    )
    return kept.select("o_orderpriority", "o_orderkey")


@query(
    """
    SELECT event_type, event_id, row_number() OVER (
             PARTITION BY event_type ORDER BY value < 20, date_trunc('second', ts) DESC, event_id
           ) AS rank
    FROM events QUALIFY rank <= 60
    """
)
def newest_first(spark, sf_dir):
    """Arrival by publish time where the landed order is unknown; unreadable times come last."""
    published = F.when(F.col("value") < 20, "soon").otherwise(iso_text("ts"))
    events = table(spark, sf_dir, "events").select(
        FEED, "event_id", times.newest_first(published).alias("age"), F.lit(False).alias("old")
    )
    kept = arrival.collected(events, [FEED], "old", ["age", "event_id"], 60)
    return kept.select(FEED, "event_id", "rank")


@query(
    """
    WITH pages AS (
      SELECT event_type, event_id // 500 AS page_no, count(*) AS n_items FROM events GROUP BY ALL),
    ended AS (
      SELECT *, count(*) FILTER (n_items < 88) OVER w AS ends,
             sum(n_items) OVER w AS before
      FROM pages
      WINDOW w AS (PARTITION BY event_type ORDER BY page_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_type, page_no, n_items, CAST(coalesce(before, 0) AS BIGINT) AS start
    FROM ended WHERE ends = 0
    """
)
def page_continuation(spark, sf_dir):
    """Pages of 500 event numbers; one with fewer than 88 items of the feed is short."""
    pages = (
        table(spark, sf_dir, "events")
        .groupBy(FEED, F.floor(F.col("event_id") / 500).alias("page_no"))
        .agg(F.count("*").alias("n_items"))
    )
    consumed = arrival.consumed_pages(pages, [FEED], "page_no", "n_items", 88)
    summed = running_total(consumed, [FEED], [F.col("page_no")], F.col("n_items"), "start")
    return summed.withColumn("start", F.col("start") - F.col("n_items"))


@query(
    """
    WITH both_branches AS (
      SELECT 0 AS branch, event_type, user_id, event_id FROM events WHERE value >= 100
      UNION ALL
      SELECT 1, event_type, user_id, event_id FROM events),
    firsts AS (
      SELECT * FROM both_branches
      QUALIFY row_number() OVER (
        PARTITION BY event_type, user_id ORDER BY branch, event_id DESC) = 1)
    SELECT event_type, user_id, event_id, branch FROM firsts
    """
)
def union_branches(spark, sf_dir):
    """A rich branch before a full one that overlaps it; the rich one wins."""
    events = table(spark, sf_dir, "events").select(
        FEED, "user_id", "event_id", (-F.col("event_id")).alias("age"), "value"
    )
    rich = events.filter(F.col("value") >= 100).drop("value")
    union = grouping.ordered_union([rich, events.drop("value")])
    return arrival.first_seen(union, [FEED, "user_id"], ["branch", "age"]).drop("age")


@query(
    """
    SELECT conv_id, turn, role, text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
           count(*) OVER (PARTITION BY conv_id) AS n_items
    FROM conversations
    """
)
def group_by_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return grouping.by_query(turns, "conv_id", ["turn"])


BROKEN_TIMES = """
    CASE WHEN value < 10 THEN 'not-a-date' WHEN value < 15 THEN '' WHEN value < 20 THEN NULL
         WHEN value < 30 THEN '2024' WHEN value < 40 THEN '10:00:00'
         WHEN value < 50 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
         WHEN value < 55 THEN strftime(ts, '%Y-%m-%dT%H')
         WHEN value < 60 THEN strftime(ts, '%Y%m%dT%H%M%S')
         WHEN value < 65 THEN strftime(ts, '%Y%m%dT%H%M%S') || 'Z'
         WHEN value < 70 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02'
         WHEN value < 75 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ',5'
         WHEN value < 80 THEN strftime(ts, '%G-W%V-%u')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END
"""


@query(
    f"""
    SELECT event_id, published FROM (SELECT *, {BROKEN_TIMES} AS published FROM events)
    WHERE NOT (value >= 40 AND CASE WHEN value < 50 OR value >= 65 AND value < 70
                                         THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                                    WHEN value >= 50 AND value < 55 THEN date_trunc('hour', ts)
                                    WHEN value >= 75 AND value < 80 THEN date_trunc('day', ts)
                                    ELSE date_trunc('second', ts) END < TIMESTAMP '2024-01-15')
    """
)
def recency_filter(spark, sf_dir):
    """Broken, blank, partial and zoned time texts; what cannot be read is kept."""
    value, moment = F.col("value"), iso_text("ts")
    week_date = F.format_string(
        "%04d-W%02d-%d",
        F.extract(F.lit("YEAROFWEEK"), "ts").cast("int"),
        F.weekofyear("ts"),
        F.weekday("ts") + 1,
    )
    published = (
        F.when(value < 10, "not-a-date")
        .when(value < 15, "")
        .when(value < 20, None)
        .when(value < 30, "2024")
        .when(value < 40, "10:00:00")
        .when(value < 50, F.concat(moment, F.lit("+02:00")))
        .when(value < 55, F.date_format("ts", "yyyy-MM-dd'T'HH"))
        .when(value < 60, F.date_format("ts", "yyyyMMdd'T'HHmmss"))
        .when(value < 65, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
        .when(value < 70, F.concat(moment, F.lit("+02")))
        .when(value < 75, F.concat(moment, F.lit(",5")))
        .when(value < 80, week_date)
        .otherwise(moment)
    )
    events = table(spark, sf_dir, "events").select("event_id", published.alias("published"))
    return events.filter(
        ~times.older_than_time(F.col("published"), datetime(2024, 1, 30), 15)
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
                       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published
    FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '2000-01-01'
    """
)
def recency_filter_date(spark, sf_dir):
    """Dates as text; one with a time part is no date and is kept."""
    published = F.when(F.col("o_orderstatus") == "P", iso_text("o_orderdate")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", published.alias("published"))
    return orders.filter(
        ~times.older_than_date(F.col("published"), datetime(2000, 1, 31, 12), 30)
    )


@query(
    """
    SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS days,
           CAST(CASE WHEN days <= 1 THEN 86400 WHEN days <= 7 THEN 604800 ELSE 2592000 END AS BIGINT)
             AS seconds
    FROM events
    """
)
def time_window_bucket(spark, sf_dir):
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", days.alias("days"))
        .withColumn("seconds", times.window_seconds(F.col("days")))
    )
