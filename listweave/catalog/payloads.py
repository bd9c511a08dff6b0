"""JSON and HTML payloads, parsed and normalised.

Payload pages are made from the tables by Spark: fifty jobs to a page, as a fetcher lands them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listweave.catalog.base import iso_text, query, table
from listweave.catalog.texts import sql_band
from listweave.functions.html import list_links, page_headings
from listweave.plans import normalise
from listweave.schemas import API_RESULTS, JOB_COLUMNS
from listweave.sources import json_pages

PAGE_JOBS = 50
RECORD = [c for c in JOB_COLUMNS if c != "scraped_at"]


def paged(jobs, key: str, size: int, group: tuple[str, ...] = ()):
    """Array of the jobs of each page in key order. Keys are unique, so a page stays small."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_at"), "job")))
    return jobs.groupBy(*group, F.floor(F.col(key) / size).alias("page_no")).agg(
        F.transform(in_order, lambda entry: entry["job"]).alias("jobs")
    )


def in_envelope(jobs):
    for level in reversed(API_RESULTS.split(".")):
        jobs = F.struct(jobs.alias(level))
    return F.to_json(jobs)


def state_payloads(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    price, moment = F.col("o_totalprice"), iso_text("o_orderdate")
    names = F.array(segment, F.lit(""), priority, status, F.col("c_name"), F.lit("sixth"))
    job = F.struct(
        F.when(status == "P", "").otherwise(F.col("o_orderkey").cast("string")).alias("uid"),
        F.when(priority == "5-LOW", "")
        .otherwise(F.concat(F.lit("~02"), "o_orderkey"))
        .alias("ciphertext"),
        F.when(priority != "4-NOT SPECIFIED", F.concat_ws(" ", priority, "c_name")).alias("title"),
        F.concat(F.lit("\t\n "), F.repeat(F.col("c_name"), F.length("o_orderkey") * 8), F.lit("  \n"))
        .alias("description"),
        F.when(status != "F", moment).alias("publishedOn"),
        F.when(priority != "1-URGENT", moment).otherwise("").alias("createdOn"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(0).alias("type"),
        F.struct(
            F.when(balance >= 0, balance).otherwise(0.0).alias("min"),
            F.when(price > 100_000, price).alias("max"),
        ).alias("hourlyBudget"),
        F.when(price > 50_000, F.struct(price.alias("amount"))).alias("amount"),
        F.when(priority == "2-HIGH", "").otherwise(segment).alias("durationLabel"),
        F.when(segment == "BUILDING", "Expert")
        .when(segment == "MACHINERY", "Intermediate tier")
        .when(segment == "HOUSEHOLD", "Entry Level")
        .when(segment == "FURNITURE", segment)
        .alias("tierText"),
        F.when(status != "P", F.transform(names, lambda n: F.struct(n.alias("prettyName"))))
        .alias("attrs"),
        F.struct(
            F.struct(F.when(balance > 0, F.col("c_nationkey").cast("string")).alias("country"))
            .alias("location"),
            F.when(balance > 5000, True).when(balance > 0, False).alias("isPaymentVerified"),
            F.when(
                balance > 1000, F.struct((price.cast("decimal(18,2)") * 10).alias("amount"))
            ).alias("totalSpent"),
            F.when(status != "O", balance).alias("totalFeedback"),
            F.when(status != "F", F.col("o_custkey")).alias("totalReviews"),
        ).alias("client"),
    )
    pages = paged(both.select("o_orderkey", job.alias("job")), "o_orderkey", PAGE_JOBS)
    return pages.select("page_no", F.to_json("jobs").alias("payload"))


STATE_SQL = f"""
    WITH rows AS (
      SELECT *, o_orderkey // 50 AS page_no,
             row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS pos,
             CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE '~02' || o_orderkey END AS cipher,
             CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS VARCHAR) END AS low,
             CASE WHEN o_totalprice > 100000 THEN CAST(o_totalprice AS VARCHAR) END AS high,
             CASE WHEN o_totalprice > 50000 THEN CAST(o_totalprice AS VARCHAR) END AS amount,
             strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS moment,
             CASE WHEN c_acctbal > 1000
                  THEN CAST(1000 * CAST(o_totalprice AS DECIMAL(18,2)) AS HUGEINT) END AS cents
      FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT page_no, pos,
      CASE o_orderstatus WHEN 'P' THEN cipher ELSE CAST(o_orderkey AS VARCHAR) END AS job_id,
      'upwork' AS source,
      CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'N/A'
        ELSE o_orderpriority || ' ' || c_name END AS title,
      CASE o_orderstatus WHEN 'F' THEN 'HOURLY' WHEN 'O' THEN 'FIXED' ELSE 'N/A' END AS job_type,
      CASE WHEN o_orderstatus <> 'F' THEN coalesce('$' || amount, 'N/A')
        WHEN low IS NULL AND high IS NULL THEN 'N/A'
        ELSE '$' || coalesce(low, '0') || '-$' || coalesce(high, '0') || '/hr' END AS budget,
      CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'N/A'
        ELSE moment END AS publish_time,
      CASE cipher WHEN '' THEN 'N/A' ELSE 'https://www.upwork.com/jobs/' || cipher END AS url,
      left(repeat(c_name, length(CAST(o_orderkey AS VARCHAR)) * 8), 500) AS description,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'Expert' WHEN 'MACHINERY' THEN 'Intermediate'
        WHEN 'HOUSEHOLD' THEN 'Entry' WHEN 'FURNITURE' THEN 'FURNITURE' ELSE 'N/A' END
        AS experience_level,
      CASE o_orderpriority WHEN '2-HIGH' THEN 'N/A' ELSE c_mktsegment END AS duration,
      CASE o_orderstatus WHEN 'P' THEN '' ELSE c_mktsegment || ', ' || o_orderpriority || ', '
        || o_orderstatus || ', ' || c_name END AS skills,
      CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS client_country,
      CASE WHEN c_acctbal > 5000 THEN 'Yes' WHEN c_acctbal > 0 THEN 'No' ELSE '' END
        AS client_payment_verified,
      {sql_band("cents")} AS client_total_spent,
      CASE o_orderstatus WHEN 'F' THEN '' ELSE CAST(o_custkey AS VARCHAR) END
        AS client_total_reviews,
      CASE o_orderstatus WHEN 'O' THEN ''
        ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS client_total_feedback
    FROM rows
"""


@query(STATE_SQL)
def normalise_state(spark, sf_dir):
    jobs = json_pages.state_jobs(state_payloads(spark, sf_dir))
    records = normalise.state_listings(jobs, F.lit(""))
    return records.select("page_no", F.col("pos").cast("bigint").alias("pos"), *RECORD)


def api_payloads(spark, sf_dir):
    """Pages of parts in the API shape; a page with a number that ends in 7 is broken off."""
    size, kind, key = F.col("p_size"), F.col("p_type"), F.col("p_partkey")
    price = F.col("p_retailprice")
    inner = F.struct(
        F.when(kind != "SMALL", F.concat(F.lit("~02"), key)).alias("ciphertext"),
        F.when(size <= 20, "HOURLY").when(size <= 40, "FIXED").alias("jobType"),
        F.when(kind != "PROMO", price).alias("hourlyBudgetMin"),
        (price * 2).alias("hourlyBudgetMax"),
        F.when(kind != "ECONOMY", F.struct(price.alias("amount"))).alias("fixedPriceAmount"),
        F.when(kind != "LARGE", F.concat(F.lit("2026-03-"), size)).alias("publishTime"),
        F.when(kind == "MEDIUM", "ExpertLevel").otherwise(F.col("p_brand")).alias("contractorTier"),
    )
    job = F.struct(
        F.when(size < 5, "").otherwise(key.cast("string")).alias("id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("description"),
        F.when(size < 48, F.struct(inner.alias("job"))).alias("jobTile"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", job.alias("job"))
    pages = paged(parts, "p_partkey", PAGE_JOBS)
    whole = in_envelope(F.col("jobs"))
    landed = F.when(F.col("page_no").cast("string").endswith("7"), F.left(whole, F.lit(100)))
    return pages.select("page_no", landed.otherwise(whole).alias("payload"))


@query(
    """
    WITH rows AS (
      SELECT *, p_partkey // 50 AS page_no,
             row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS pos,
             p_size < 48 AS tiled,
             CASE WHEN p_size < 48 AND p_type <> 'SMALL' THEN '~02' || p_partkey ELSE '' END
               AS cipher,
             CAST(p_retailprice AS VARCHAR) AS low, CAST(p_retailprice * 2 AS VARCHAR) AS high
      FROM part)
    SELECT page_no, pos,
      CASE WHEN p_size < 5 THEN cipher ELSE CAST(p_partkey AS VARCHAR) END AS job_id,
      'upwork' AS source, p_name AS title,
      CASE WHEN p_size <= 20 THEN 'HOURLY' WHEN p_size <= 40 THEN 'FIXED' ELSE 'N/A' END AS job_type,
      CASE WHEN p_size <= 20 THEN '$' || CASE p_type WHEN 'PROMO' THEN '?' ELSE low END
             || '-$' || high || '/hr'
           WHEN tiled AND p_type <> 'ECONOMY' THEN '$' || low ELSE 'N/A' END AS budget,
      CASE WHEN tiled AND p_type <> 'LARGE' THEN '2026-03-' || p_size ELSE 'N/A' END
        AS publish_time,
      CASE cipher WHEN '' THEN 'N/A' ELSE 'https://www.upwork.com/jobs/' || cipher END AS url,
      p_name AS description,
      CASE WHEN NOT tiled THEN 'N/A' WHEN p_type = 'MEDIUM' THEN 'Expert' ELSE p_brand END
        AS experience_level,
      'N/A' AS duration, '' AS skills, '' AS client_country, '' AS client_payment_verified,
      '' AS client_total_spent, '' AS client_total_reviews, '' AS client_total_feedback
    FROM rows WHERE right(CAST(page_no AS VARCHAR), 1) <> '7'
    """
)
def normalise_api(spark, sf_dir):
    """Broken pages give no jobs, missing inner objects give blanks."""
    jobs = json_pages.api_jobs(api_payloads(spark, sf_dir))
    records = normalise.api_listings(jobs, F.lit(""))
    return records.select("page_no", F.col("pos").cast("bigint").alias("pos"), *RECORD)


@query(
    """
    SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k FROM events
    """
)
def json_fields(spark, sf_dir):
    props = F.from_json("props", "struct<k: string, missing: struct<deep: string>>")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


@query(
    """
    WITH items AS (
      SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
             regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels
      FROM pages)
    SELECT page_id, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href, unnest(labels) AS label
    FROM items
    """
)
def card_extract(spark, sf_dir):
    """List items with a link, in document order."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.posexplode(list_links("html")).alias("pos", "link"))
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link.href", "link.label")


def sql_unescaped(html_text: str) -> str:
    marks = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")]
    for mark, plain in marks:
        html_text = f"replace({html_text}, '{mark}', '{plain}')"
    return html_text


@query(
    f"""
    SELECT page_id, trim({sql_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
           trim({sql_unescaped("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS headline
    FROM pages
    """
)
def page_fields(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", page_headings("html").alias("found")).select("page_id", "found.*")
