"""Text rules on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listweave.catalog.base import iso_text, query, table
from listweave.functions import money, text
from listweave.plans.normalise import with_typed_job_columns

TEXT_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def sql_band(cents: str) -> str:
    """Spend band from a whole number of cents, half-even by whole-number arithmetic."""

    def rounded(unit: int) -> str:
        rest = f"(c % {unit})"
        up = f"(2 * {rest} > {unit} OR (2 * {rest} = {unit} AND (c // {unit}) % 2 = 1))"
        return f"(c // {unit} + CASE WHEN {up} THEN 1 ELSE 0 END)"

    tenths = rounded(10_000_000)
    return f"""(SELECT CASE
        WHEN c IS NULL OR c = 0 THEN ''
        WHEN c >= 100000000 THEN '$' || ({tenths} // 10) || '.' || ({tenths} % 10) || 'M+'
        WHEN c >= 100000 THEN '$' || {rounded(100_000)} || 'K+'
        ELSE '$' || {rounded(100)} END FROM (SELECT {cents} AS c))"""


@query(
    f"""
    SELECT doc_id, left(trim(chr(9) || ' ' || text || chr(10) || chr(160), {TEXT_BLANKS}), 500)
             AS description
    FROM documents
    """
)
def excerpt(spark, sf_dir):
    """White space of several kinds around the text, then the first 500 characters."""
    padded = F.concat(F.lit("\t "), "text", F.lit("\n "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.excerpt(padded).alias("description")
    )


@query(
    """
    SELECT p_partkey,
           CASE p_type WHEN 'ECONOMY' THEN 'N/A' WHEN 'STANDARD' THEN 'Entry'
             WHEN 'LARGE' THEN 'Expert' WHEN 'SMALL' THEN 'Intermediate'
             WHEN 'MEDIUM' THEN 'Intermediate' ELSE p_type || ' ' || p_brand END
             AS experience_level
    FROM part
    """
)
def experience_level(spark, sf_dir):
    kind = F.col("p_type")
    raw = (
        F.when(kind == "ECONOMY", "")
        .when(kind == "STANDARD", "Basic / ENTRY level")
        .when(kind == "LARGE", "ExpertLevel, formerly intermediate")
        .when(kind == "SMALL", "Mid-Senior entry")
        .when(kind == "MEDIUM", "IntermediateLevel")
        .otherwise(F.concat(kind, F.lit(" "), F.col("p_brand")))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.experience_level(raw).alias("experience_level")
    )


@query(
    """
    SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'HOURLY' WHEN 2 THEN 'FIXED' ELSE 'N/A' END
             AS job_type
    FROM part
    """
)
def job_type_code(spark, sf_dir):
    code = (F.col("p_size") % 3).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", text.job_type(code).alias("job_type"))


@query(
    """
    WITH prices AS (
      SELECT l_partkey, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS low,
             max(CAST(l_extendedprice AS DECIMAL(18,2))) AS high, min(l_linenumber) AS line
      FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey,
           CASE WHEN line = 1 THEN '$' || low || '-$' || high || '/hr'
                WHEN line = 2 THEN '$0-$' || high || '/hr' ELSE 'N/A' END AS state_hourly,
           CASE WHEN line = 1 THEN '$' || low ELSE 'N/A' END AS state_fixed,
           CASE WHEN line = 1 THEN '$' || low ELSE '$?' END || '-$' || high || '/hr' AS api_hourly,
           CASE WHEN line = 1 THEN '$' || low ELSE 'N/A' END AS api_fixed
    FROM prices
    """
)
def budget_text(spark, sf_dir):
    """Price range per part as the four budget forms, with sides that are missing or zero."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    prices = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.min(price).cast("string").alias("low"),
            F.max(price).cast("string").alias("high"),
            F.min("l_linenumber").alias("line"),
        )
    )
    line = F.col("line")
    low = F.when(line == 1, F.col("low")).when(line == 2, "0.0")
    known = F.when(line == 1, F.col("low"))
    high = F.when(line <= 2, F.col("high"))
    hourly, fixed = F.lit("HOURLY"), F.lit("FIXED")
    return prices.select(
        "l_partkey",
        money.state_budget(hourly, low, high, F.lit(None)).alias("state_hourly"),
        money.state_budget(fixed, F.lit(None), F.lit(None), low).alias("state_fixed"),
        money.api_budget(hourly, known, F.col("high"), F.lit(None)).alias("api_hourly"),
        money.api_budget(fixed, F.lit(None), F.lit(None), known).alias("api_fixed"),
    )


@query(
    f"""
    WITH totals AS (
      SELECT o_custkey, CAST(100 * sum(CAST(o_totalprice AS DECIMAL(18,2))) AS HUGEINT) AS cents
      FROM orders GROUP BY o_custkey)
    SELECT o_custkey, {sql_band("cents")} AS spent, {sql_band("cents // 1000")} AS spent_small
    FROM totals
    """
)
def money_band(spark, sf_dir):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(total.alias("total"))
    small = F.floor(F.col("total") / 10).cast("decimal(28,2)") / 100
    return totals.select(
        "o_custkey",
        money.spend_band(F.col("total")).alias("spent"),
        money.spend_band(small).alias("spent_small"),
    )


@query(
    """
    SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN ''
             ELSE CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS feedback,
           CASE WHEN s_nationkey < 5 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS reviews
    FROM supplier
    """
)
def feedback_text(spark, sf_dir):
    known = F.col("s_nationkey") >= 5
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        money.two_decimals(F.when(known, F.col("s_acctbal"))).alias("feedback"),
        money.whole_number(F.when(known, F.col("s_nationkey"))).alias("reviews"),
    )


@query(
    """
    SELECT doc_id, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '' END AS verified
    FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def tri_state(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return labelled.select("doc_id", text.yes_no(F.col("quality") == 1).alias("verified"))


@query(
    """
    SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' ')[1:5],
             lambda x: x <> ''), ', ') AS skills
    FROM documents
    """
)
def skills_top5(spark, sf_dir):
    """First five words; empty ones among them leave fewer."""
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", text.top_skills(words).alias("skills"))


@query(
    """
    SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 2000 THEN '' ELSE c_mktsegment END, ''),
             nullif(CASE WHEN c_nationkey < 10 THEN '' WHEN c_nationkey < 20 THEN c_name END, ''),
             'N/A') AS publish_time
    FROM customer
    """
)
def fallback_chain(spark, sf_dir):
    first = F.when(F.col("c_acctbal") < 2000, "").otherwise(F.col("c_mktsegment"))
    second = F.when(F.col("c_nationkey") < 10, "").when(F.col("c_nationkey") < 20, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.first_filled(first, second, default=text.MISSING).alias("publish_time")
    )


@query(
    """
    SELECT page_id, string_split(url, '?')[1] AS plain_url,
           CASE WHEN string_split(url, '?')[2] IS NULL THEN 'N/A'
                ELSE 'https://www.upwork.com/jobs/~' || string_split(url, '?')[2] END AS job_url
    FROM pages
    """
)
def url_fields(spark, sf_dir):
    query_part = F.get(F.split("url", r"\?"), 1)
    cipher = F.coalesce(F.concat(F.lit("~"), query_part), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.without_query(F.col("url")).alias("plain_url"),
        text.job_url(cipher).alias("job_url"),
    )


@query(
    """
    SELECT page_id, string_split(url, '/')[-1] AS tail,
           string_split('urn:li:jobPosting:' || page_id, ':')[-1] AS job_id
    FROM pages
    """
)
def urn_tail(spark, sf_dir):
    urn = F.concat(F.lit("urn:li:jobPosting:"), "page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.urn_tail(F.col("url"), "/").alias("tail"),
        text.urn_tail(urn).alias("job_id"),
    )


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'F' THEN '$' || o_custkey
                ELSE '$' || CASE o_orderkey % 3 WHEN 0 THEN '?' WHEN 1 THEN 'None'
                                 ELSE CAST(o_custkey AS VARCHAR) END
                     || '-$' || CASE o_orderkey % 2 WHEN 0 THEN '?' ELSE 'None' END || '/hr' END
             AS budget,
           CASE WHEN o_orderkey % 10 = 0 THEN '~x0' || o_custkey
                ELSE substr('~0' || o_orderkey, 4) END AS key,
           ltrim('~0' || o_orderkey, '~0') AS loose_key
    FROM orders
    """
)
def budget_exact_and_keys(spark, sf_dir):
    """API budgets that tell a null side from an absent one, and cipher keys without version."""
    customer = F.col("o_custkey").cast("string")
    number = F.col("o_orderkey")
    fields = F.concat_ws(
        ",",
        F.when(number % 3 == 1, '"hourlyBudgetMin":null').when(
            number % 3 == 2, F.concat(F.lit('"hourlyBudgetMin":'), customer)
        ),
        F.when(number % 2 == 1, '"hourlyBudgetMax":null'),
        F.concat(F.lit('"fixedPriceAmount":{"amount":'), customer, F.lit("}")),
    )
    job = F.from_json(F.concat(F.lit("{"), fields, F.lit("}")), "map<string,string>")
    kind = F.when(F.col("o_orderstatus") == "F", "FIXED").otherwise("HOURLY")
    cipher = F.when(number % 10 == 0, F.concat(F.lit("~x0"), customer)).otherwise(
        F.concat(F.lit("~0"), number.cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        money.api_budget_exact(kind, job).alias("budget"),
        text.stripped_cipher(cipher, strip_version=True).alias("key"),
        text.stripped_cipher(F.concat(F.lit("~0"), number.cast("string"))).alias("loose_key"),
    )


@query(
    """
    SELECT o_orderkey,
           CASE o_orderstatus WHEN 'O' THEN NULL ELSE CAST(o_custkey AS DECIMAL(18,2)) END AS budget_min,
           CASE o_orderstatus WHEN 'O' THEN NULL
                WHEN 'P' THEN CAST(o_custkey + 5 AS DECIMAL(18,2))
                ELSE CAST(o_custkey AS DECIMAL(18,2)) END AS budget_max,
           CASE WHEN o_orderkey % 4 > 0 THEN epoch_us(date_trunc('second', o_orderdate)) END
             AS published,
           CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_skills,
           CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS payment_verified,
           CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS total_reviews,
           CASE WHEN o_orderkey % 5 > 0 THEN o_custkey / 4 END AS total_feedback
    FROM orders
    """
)
def typed_columns(spark, sf_dir):
    """Typed companions of the text columns of job records, null where a text says nothing."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    dollars = F.concat(F.lit("$"), customer)
    higher = (F.col("o_custkey") + 5).cast("string")
    texts = {
        "budget": F.when(F.col("o_orderstatus") == "O", "N/A")
        .when(F.col("o_orderstatus") == "P", F.concat(dollars, F.lit("-$"), higher, F.lit("/hr")))
        .otherwise(dollars),
        "client_payment_verified": F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "No").otherwise(""),
        "publish_time": F.when(key % 4 == 0, "soon").otherwise(iso_text("o_orderdate")),
        "skills": F.when(key % 2 == 0, "one, two").otherwise(""),
        "client_total_reviews": F.when(key % 5 == 0, "").otherwise(customer),
        "client_total_feedback": F.when(key % 5 == 0, "").otherwise(
            (F.col("o_custkey") / 4).cast("string")
        ),
        "scraped_at": F.lit(""),
    }
    listings = table(spark, sf_dir, "orders").select(
        "o_orderkey", *[column.alias(name) for name, column in texts.items()]
    )
    return with_typed_job_columns(listings).select(
        "o_orderkey",
        F.col("budget_min").cast("decimal(18,2)").alias("budget_min"),
        F.col("budget_max").cast("decimal(18,2)").alias("budget_max"),
        F.unix_micros("publish_ts").alias("published"),
        F.size("skills_arr").cast("bigint").alias("n_skills"),
        "payment_verified",
        "total_reviews",
        "total_feedback",
    )
