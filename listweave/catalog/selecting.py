"""Facets, keywords, lookups, enrichment, ranking and requests on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listweave.catalog.base import query, table
from listweave.operators import enrich, filters, matching, ranking
from listweave.sources import manifest


@query(
    """
    SELECT o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')
    """
)
def facet_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    wanted = {
        "o_orderstatus": ["F", "O"],
        "o_orderpriority": ["1-URGENT", "2-HIGH"],
        "c_mktsegment": ["BUILDING", "MACHINERY", "FURNITURE"],
    }
    return filters.facet_filter(orders, wanted).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment"
    )


@query(
    """
    WITH listed AS (
      SELECT doc_id, unnest(list_filter(list_transform(
               string_split(' ' || source || ' ,, ' || lang || ',' || chr(9) || 'en , ', ','),
               lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')) AS code,
             generate_subscripts(list_filter(list_transform(
               string_split(' ' || source || ' ,, ' || lang || ',' || chr(9) || 'en , ', ','),
               lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), 1) - 1 AS code_pos
      FROM documents)
    SELECT doc_id, code_pos, code, code IN (SELECT lang FROM documents) AS is_known FROM listed
    """
)
def facet_parse(spark, sf_dir):
    """Comma-separated codes with blanks and empty items, checked against a code table."""
    documents = table(spark, sf_dir, "documents")
    codes = F.concat(
        F.lit(" "), "source", F.lit(" ,, "), "lang", F.lit(",\ten , ")
    )
    listed = documents.select("doc_id", codes.alias("codes"))
    known = documents.select("lang").distinct()
    return filters.parsed_facets(listed, "codes", known, "lang").select(
        "doc_id", F.col("code_pos").cast("bigint").alias("code_pos"), "code", "is_known"
    )


@query(
    """
    SELECT doc_id, lang, n_chars FROM documents
    WHERE contains(lower(source || ' ' || text), 'the') AND contains(lower(text), 'and')
    """
)
def keyword_filter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    matching = filters.keyword_filter(
        documents, F.lit("The  AND"), F.col("source"), F.col("text")
    )
    return matching.select("doc_id", "lang", "n_chars")


@query(
    """
    SELECT c_custkey, c_nationkey, n_name FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """
)
def code_lookup(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return filters.labelled(customers, codes, "c_nationkey")


@query(
    """
    SELECT doc_id, source, coalesce(CAST(quality AS VARCHAR), '') AS quality,
           coalesce(CAST(toxic AS VARCHAR), '') AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def enrich_left(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"),
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return enrich.with_blanks(documents, labels, "doc_id")


@query(
    """
    WITH last AS (
      SELECT user_id, event_type, arg_max(props ->> '$.k', event_id) AS k
      FROM events GROUP BY ALL)
    SELECT user_id, count(*) AS n_criteria,
           string_agg(event_type || '=' || k, ';' ORDER BY event_type) AS criteria,
           coalesce(max(k) FILTER (event_type = 'signup'), '') AS workplace
    FROM last GROUP BY user_id
    """
)
def criteria_map(spark, sf_dir):
    """Last value per header, and one header picked with a blank as fallback."""
    k = F.get_json_object("props", "$.k")
    maps = enrich.last_values(
        table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), k, F.col("event_id")
    )
    pairs = F.transform(
        F.array_sort(F.map_keys("values")),
        lambda key: F.concat(key, F.lit("="), F.element_at("values", key)),
    )
    return maps.select(
        "user_id",
        F.size("values").cast("bigint").alias("n_criteria"),
        F.array_join(pairs, ";").alias("criteria"),
        F.coalesce(F.element_at("values", F.lit("signup")), F.lit("")).alias("workplace"),
    )


@query(
    """
    SELECT p_partkey, p_name, CAST(p_retailprice AS DECIMAL(18,2)) AS budget_max FROM part
    WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= 910
      AND NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'gear')
    """
)
def budget_min_filter(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(18,2)")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.concat(F.lit("$"), price.cast("string")).alias("budget")
    )
    kept = ranking.budget_at_least(
        parts, F.col("budget"), 910, ["Red", "gear"], F.col("p_name")
    )
    _, highest = ranking.budget_bounds(F.col("budget"))
    return kept.select("p_partkey", "p_name", highest.alias("budget_max"))


@query(
    """
    WITH scored AS (
      SELECT lang, doc_id,
             2 * CAST(contains(lower(source), 'src1') AS INT)
             + CAST(contains(lower(text), 'src1') AS INT)
             + 2 * CAST(contains(lower(source), 'the') AS INT)
             + CAST(contains(lower(text), 'the') AS INT)
             + 2 * CAST(contains(lower(source), 'und') AS INT)
             + CAST(contains(lower(text), 'und') AS INT) AS score
      FROM documents)
    SELECT lang, doc_id, CAST(score AS BIGINT) AS score FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC) <= 10
    """
)
def relevance_rank(spark, sf_dir):
    """Top ten per language: source counts as title, newer documents first on ties."""
    documents = table(spark, sf_dir, "documents")
    score = ranking.relevance(["src1", "the", "und"], F.col("source"), F.col("text"))
    top = ranking.most_relevant(documents, ["lang"], score, [-F.col("doc_id")], 10)
    return top.select("lang", "doc_id", "score")


@query(
    """
    SELECT c_custkey, start,
           'keywords=' || replace(url_encode(c_name || ' & co*~'), '%20', '+')
           || '&start=' || start || '&sortBy=DD&location=' || url_encode(n_name)
           || '&f_E=2%2C4&f_JT=F&f_TPR=r604800' AS parameters
    FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest([0, 25, 50]) AS start)
    """
)
def request_manifest(spark, sf_dir):
    facets = filters.Facets.of({"experience_levels": "2, 4", "employment_types": ["F"]})
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.concat("c_name", F.lit(" & co*~")).alias("query")
    )
    queries = filters.labelled(customers, nations, "c_nationkey")
    requests = manifest.card_requests(
        queries.filter(F.col("n_name").isNotNull()), 3, facets, days=5, location=F.col("n_name")
    )
    return requests.select("c_custkey", "start", "parameters")


@query(
    """
    SELECT c_custkey, start,
           '{"requestVariables":{"userQuery":"' || c_name || '","sort":"recency",'
           || '"paging":{"offset":' || start || ',"count":50}}}' AS variables
    FROM customer, (SELECT unnest([0, 50]) AS start)
    """
)
def api_requests(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    requests = manifest.api_requests(customers, 2, query="c_name")
    return requests.select("c_custkey", "start", "variables")


#: The query of an item: its first three words.
ITEM_QUERY = "array_to_string(string_split(text, ' ')[1:3], ' ')"


def _item_queries(spark, sf_dir):
    first = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", first.alias("asked"))


@query(
    f"""
    WITH asked AS (
      SELECT item_id, list_distinct(list_filter(string_split_regex(
               lower({ITEM_QUERY}), '\\s+'), lambda t: t <> '')) AS terms
      FROM benchmark)
    SELECT item_id, doc_id FROM asked, documents
    WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(
            lower(coalesce(source, '') || ' ' || coalesce(text, '')), t))) = 0
    """
)
def many_keyword_queries(spark, sf_dir):
    """The documents that have all terms of each item's query, for all items at once."""
    documents = table(spark, sf_dir, "documents")
    found = matching.all_terms_match(
        documents, "doc_id", ["source", "text"], _item_queries(spark, sf_dir), "item_id", "asked"
    )
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"))


@query(
    f"""
    WITH asked AS (
      SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(
               lower({ITEM_QUERY}), '\\s+'), lambda t: t <> ''))) AS term
      FROM benchmark),
    scored AS (
      SELECT item_id, doc_id,
             CAST(sum(2 * CAST(contains(lower(coalesce(source, '')), term) AS INT)
                      + CAST(contains(lower(coalesce(text, '')), term) AS INT)) AS BIGINT) AS score
      FROM asked, documents GROUP BY ALL)
    SELECT item_id, doc_id, score FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) <= 10
    """
)
def many_relevance_queries(spark, sf_dir):
    """Top ten documents for each item's query; newer documents first on ties."""
    top = matching.most_relevant_for(
        table(spark, sf_dir, "documents"),
        "doc_id",
        {"source": 2, "text": 1},
        _item_queries(spark, sf_dir),
        "item_id",
        "asked",
        [-F.col("key")],
        10,
    )
    return top.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score")
