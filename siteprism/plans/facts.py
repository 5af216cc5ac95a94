"""Keyword, audit-run and tenant facts derived from the star-schema tables.

Each function has its SQL twin as a constant next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.plans.registry import table


def _pick(key: F.Column, k: int, *values) -> F.Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % k == i, F.lit(v)).otherwise(out)
    return out


SUFFIXES = [" buy", " best", " how to", " hotel mallorca", " hotel", "", " guide"]
INTENTS = ["informational", "commercial", "transactional", "navigational"]


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked keywords: one per part."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("keyword_id"), F.concat(F.lit("s"), (k % 40).cast("string")).alias("site_id"), k.alias("seq"),
        F.concat("p_name", _pick(k, 7, *SUFFIXES), F.lit(" "), (k % 300).cast("string")).alias("text"),
        F.when(k % 11 != 0, F.col("p_size") * (k % 97)).cast("int").alias("search_volume"),
        F.round("p_retailprice", 1).alias("cpc"), ((k % 100) / 100.0).alias("competition"),
        F.when(k % 13 != 0, k % 101).cast("int").alias("difficulty"),
        _pick(k, 5, *INTENTS).alias("intent"), (k % 3 != 0).alias("is_tracked"),
        F.when(k % 7 != 0, k * 31 % 100 + 1).cast("int").alias("current_position"),
        F.when(k % 9 != 0, k * 17 % 100 + 1).cast("int").alias("previous_position"),
        F.when(k % 4 != 0, k * 13 % 100 + 1).cast("int").alias("best_position"),
    )


KEYWORDS = f"""kw AS (SELECT p_partkey AS keyword_id, 's' || (p_partkey % 40) AS site_id, p_partkey AS seq,
  p_name || (CASE p_partkey % 7 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))} END) || ' ' || (p_partkey % 300) AS text,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_size * (p_partkey % 97))::INT END AS search_volume,
  round(p_retailprice, 1) AS cpc, (p_partkey % 100) / 100.0::DOUBLE AS competition,
  CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 101)::INT END AS difficulty,
  CASE p_partkey % 5 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(INTENTS))} END AS intent, p_partkey % 3 <> 0 AS is_tracked,
  CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey * 31 % 100 + 1)::INT END AS current_position,
  CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 17 % 100 + 1)::INT END AS previous_position,
  CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 13 % 100 + 1)::INT END AS best_position FROM part)"""

_SEQ = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey)"


def line_seq() -> F.Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Rank checks: one per order line."""
    pos = (F.col("l_linenumber") * F.col("l_quantity").cast("int") % 100 + 1).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("keyword_id"), line_seq().alias("check_seq"), F.col("l_shipdate").alias("checked_at"),
        F.when(F.col("l_returnflag") != "R", pos).alias("position"),
    )


HISTORY = f"""hist AS (SELECT l_partkey AS keyword_id, {_SEQ} AS check_seq, l_shipdate AS checked_at,
  CASE WHEN l_returnflag <> 'R' THEN (l_linenumber * l_quantity::INT % 100 + 1)::INT END AS position FROM lineitem)"""


def serp_items(spark: SparkSession, sf: str) -> DataFrame:
    """Search results: an order is a keyword, its lines are the result items."""
    k = F.col("l_orderkey") + F.col("l_linenumber") * 3
    kinds = ["featured_snippet", "people_also_ask", "video", "images", "knowledge_graph", "shopping", "local_pack", "top_stories"]
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("keyword"), line_seq().alias("item_seq"),
        F.coalesce(_pick(k, 24, *kinds), F.lit("organic")).alias("type"), F.col("l_linenumber").alias("rank_group"),
        F.concat(F.when(F.col("l_suppkey") % 3 == 0, "WWW.").otherwise(""), F.lit("site"), F.col("l_suppkey").cast("string"), F.lit(".com")).alias("domain"),
        F.concat(
            F.lit("https://site"), F.col("l_suppkey").cast("string"), F.lit(".com/"),
            F.coalesce(_pick(F.col("l_partkey"), 3, "blog/", "article/"), F.lit("")), F.col("l_partkey").cast("string"),
        ).alias("url"),
        F.coalesce(_pick(F.col("l_partkey"), 9, "The guide", "A review", "Best of", "This vs that", "How to"), F.lit("Plain")).alias("title"),
        (F.col("l_quantity") > 45).alias("has_links"), (F.col("l_discount") > 0.08).alias("has_rating"),
    )


SERP = f"""serp AS (SELECT l_orderkey AS keyword, {_SEQ} AS item_seq,
  CASE (l_orderkey + l_linenumber * 3) % 24 WHEN 0 THEN 'featured_snippet' WHEN 1 THEN 'people_also_ask' WHEN 2 THEN 'video' WHEN 3 THEN 'images'
    WHEN 4 THEN 'knowledge_graph' WHEN 5 THEN 'shopping' WHEN 6 THEN 'local_pack' WHEN 7 THEN 'top_stories' ELSE 'organic' END AS type,
  l_linenumber AS rank_group, CASE WHEN l_suppkey % 3 = 0 THEN 'WWW.' ELSE '' END || 'site' || l_suppkey || '.com' AS domain,
  'https://site' || l_suppkey || '.com/' || (CASE l_partkey % 3 WHEN 0 THEN 'blog/' WHEN 1 THEN 'article/' ELSE '' END) || l_partkey AS url,
  CASE l_partkey % 9 WHEN 0 THEN 'The guide' WHEN 1 THEN 'A review' WHEN 2 THEN 'Best of' WHEN 3 THEN 'This vs that' WHEN 4 THEN 'How to' ELSE 'Plain' END AS title,
  l_quantity > 45 AS has_links, l_discount > 0.08::DOUBLE AS has_rating FROM lineitem)"""


def rankings_of_sites(spark: SparkSession, sf: str) -> DataFrame:
    """(site, competitor, keyword) facts for the gap analysis, one per order line."""
    kw = keywords(spark, sf).select("keyword_id", "text", "search_volume", "difficulty", "intent")
    return table(spark, sf, "lineitem").join(kw, F.col("l_partkey") == F.col("keyword_id")).select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("site_id"), line_seq().alias("seq"),
        F.concat(F.lit("c"), (F.col("l_orderkey") % 7).cast("string")).alias("competitor"),
        (F.col("l_returnflag") == "A").alias("own"), "text", "search_volume", "difficulty", "intent",
    )


RIVALS = f"""riv AS (SELECT 's' || (l_suppkey % 20) AS site_id, {_SEQ} AS seq, 'c' || (l_orderkey % 7) AS competitor, l_returnflag = 'A' AS own,
  text, search_volume, difficulty, intent FROM lineitem JOIN kw ON l_partkey = keyword_id)"""


def audit_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Audits over time: an order is a run of its customer's site."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("site_id"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"),
        F.when(F.col("o_orderkey") % 19 != 0, F.floor(F.col("o_totalprice") / 5000).cast("int") % 101).alias("score"),
        F.col("o_orderdate").alias("completed_at"),
    )


RUNS = """runs AS (SELECT o_orderkey AS audit_id, o_custkey AS site_id, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 19 <> 0 THEN floor(o_totalprice / 5000)::INT % 101 END AS score, o_orderdate AS completed_at FROM orders)"""


def stored_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issue rows of the runs: one per order line."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("audit_id"), s.alias("site_id"), line_seq().alias("seq"),
        F.concat(F.lit("Category "), (p % 5).cast("string")).alias("category"), F.concat(F.lit("Issue "), (p % 23).cast("string")).alias("title"),
        _pick(p, 4, "low", "medium", "high", "critical").alias("severity"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("fixed").alias("status"),
        F.concat(F.lit("check_"), (p % 23).cast("string")).alias("type"), F.col("l_quantity").cast("int").alias("affected_count"),
        F.concat(F.lit("https://site"), s.cast("string"), F.lit(".com/p/"), (p % 50).cast("string")).alias("url"),
    )


ISSUES = f"""iss AS (SELECT l_orderkey AS audit_id, l_suppkey AS site_id, {_SEQ} AS seq, 'Category ' || (l_partkey % 5) AS category,
  'Issue ' || (l_partkey % 23) AS title, CASE l_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'fixed' END AS status, 'check_' || (l_partkey % 23) AS type, l_quantity::INT AS affected_count,
  'https://site' || l_suppkey || '.com/p/' || (l_partkey % 50) AS url FROM lineitem)"""
