"""Keyword and ranking queries (K-1 … K-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteprism.common import finer
from siteprism.functions import text as X
from siteprism.functions import urls as U
from siteprism.operators import keywords as K
from siteprism.operators import topics as T
from siteprism.plans import facts as D
from siteprism.plans.registry import query, table

_RX = lambda words: "regexp_matches(lower(text), '" + "|".join(words) + "')"
_INTENT = (
    f"CASE WHEN {_RX(K.TRANSACTIONAL)} THEN 'transactional' WHEN {_RX(K.COMMERCIAL)} THEN 'commercial' WHEN {_RX(K.INFORMATIONAL)} THEN 'informational' "
    f"WHEN {_RX(K.HOTELS)} AND {_RX(K.PLACES)} THEN 'commercial' WHEN {_RX(K.HOTELS)} THEN 'navigational' ELSE 'informational' END"
)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    """Discovered rows: one per order line, the keyword's text in mixed case."""
    kw = D.keywords(spark, sf).select("keyword_id", "text", "difficulty", "intent")
    line = table(spark, sf, "lineitem").join(kw, F.col("l_partkey") == F.col("keyword_id"))
    return line.select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("site_id"), D.line_seq().alias("seq"),
        F.when(F.col("l_linestatus") == "O", F.upper("text")).otherwise(F.col("text")).alias("text"),
        F.col("l_quantity").cast("int").alias("search_volume"), F.col("l_discount").alias("cpc"), F.col("l_tax").alias("competition"),
        "difficulty", "intent",
    )


_FOUND = f"""{D.KEYWORDS}, found AS (SELECT 's' || (l_partkey % 40) AS site_id, {D._SEQ} AS seq, CASE l_linestatus WHEN 'O' THEN upper(text) ELSE text END AS text,
  l_quantity::INT AS search_volume, l_discount AS cpc, l_tax AS competition, difficulty, intent FROM lineitem JOIN kw ON l_partkey = keyword_id),
ded AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY site_id, lower(text) ORDER BY seq) = 1)"""


@query("k01_dedupe_keywords", f"WITH {_FOUND} SELECT site_id, seq, lower(text) AS key FROM ded")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return K.dedupe_keywords(_found(spark, sf)).select("site_id", "seq", F.lower("text").alias("key"))


@query(
    "k02_upsert_keywords",
    f"""WITH {_FOUND}, d AS (SELECT site_id, lower(text) AS text, min(search_volume) AS search_volume, min(difficulty) AS difficulty, min(intent) AS intent FROM found GROUP BY site_id, lower(text)),
    e AS (SELECT site_id, text, min(search_volume) AS search_volume, min(difficulty) AS difficulty, min(intent) AS intent FROM kw WHERE is_tracked GROUP BY ALL)
    SELECT coalesce(e.site_id, d.site_id) AS site_id, coalesce(e.text, d.text) AS text,
      CASE WHEN d.text IS NOT NULL THEN d.search_volume ELSE e.search_volume END AS search_volume,
      CASE WHEN e.text IS NULL THEN d.difficulty ELSE e.difficulty END AS difficulty,
      CASE WHEN e.text IS NULL THEN d.intent ELSE e.intent END AS intent, e.text IS NULL AS is_new
    FROM e FULL JOIN d ON e.site_id = d.site_id AND e.text = d.text""",
)
def k02(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["search_volume", "cpc", "competition", "difficulty", "intent"]
    small = lambda df, text: df.groupBy("site_id", text.alias("text")).agg(*[F.min(c).alias(c) for c in cols])
    existing = small(D.keywords(spark, sf).filter("is_tracked"), F.col("text"))
    return K.upsert_keywords(existing, small(_found(spark, sf), F.lower("text"))).select(
        "site_id", "text", "search_volume", "difficulty", "intent", "is_new"
    )


@query("k03_classify_intent", f"WITH {D.KEYWORDS} SELECT keyword_id, text, CASE WHEN keyword_id % 6 = 0 THEN 'navigational' ELSE {_INTENT} END AS intent FROM kw")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    api = F.when(F.col("keyword_id") % 6 == 0, F.array(F.lit("transactional"), F.lit("navigational"))).otherwise(F.array().cast("array<string>"))
    return D.keywords(spark, sf).select("keyword_id", "text", K.classify_intent(F.col("text"), api).alias("intent"))


_FLAGS = ", ".join(f"bool_or(type = '{v}') AS {k}" for k, v in K.FEATURE_TYPES.items())


@query(
    "k04_serp_features",
    f"WITH {D.SERP} SELECT keyword, {_FLAGS}, bool_or(type = 'organic' AND has_links) AS sitelinks, bool_or(type = 'organic' AND has_rating) AS reviews FROM serp GROUP BY keyword",
)
def k04(spark: SparkSession, sf: str) -> DataFrame:
    return K.serp_features(D.serp_items(spark, sf))


@query(
    "k04_competitor_positions",
    f"""WITH {D.SERP} SELECT keyword, rank_group AS position, domain, url, row_number() OVER (PARTITION BY keyword ORDER BY item_seq, domain, url)::INT AS rank
    FROM serp WHERE type = 'organic' QUALIFY rank <= 10""",
)
def k04c(spark: SparkSession, sf: str) -> DataFrame:
    return K.competitor_positions(D.serp_items(spark, sf)).select("keyword", "position", "domain", "url", "rank")


@query(
    "k05_find_position",
    f"""WITH {D.SERP}, t AS (SELECT 's' || s_suppkey AS site_id, o_orderkey AS keyword, 'site' || s_suppkey || '.com' AS d FROM orders JOIN supplier ON s_suppkey = o_custkey)
    SELECT site_id, t.keyword, m[2] AS position, m[3] AS ranking_url FROM t LEFT JOIN (
      SELECT keyword, regexp_replace(lower(domain), '^www\\.', '') AS d, arg_min([item_seq::VARCHAR, rank_group::VARCHAR, url], item_seq) AS m FROM serp WHERE type = 'organic' GROUP BY ALL) b
      ON b.keyword = t.keyword AND b.d = t.d""",
)
def k05(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf, "supplier").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    targets = o.join(s, F.col("o_custkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("s"), key).alias("site_id"), F.col("o_orderkey").alias("keyword"), F.concat(F.lit("www.site"), key, F.lit(".com")).alias("primary_domain")
    )
    return K.find_position(D.serp_items(spark, sf), targets).withColumn("position", F.col("position").cast("string"))


@query(
    "k06_update_rankings",
    f"""WITH {D.KEYWORDS}, r AS (SELECT keyword_id, keyword_id % 10 <> 0 AS success, CASE WHEN keyword_id % 8 <> 0 THEN (keyword_id * 7 % 100 + 1)::INT END AS position FROM kw)
    SELECT keyword_id, CASE WHEN success THEN current_position ELSE previous_position END AS previous_position,
      CASE WHEN success THEN position ELSE current_position END AS current_position,
      CASE WHEN success THEN least(best_position, position) ELSE best_position END AS best_position FROM kw JOIN r USING (keyword_id)""",
)
def k06(spark: SparkSession, sf: str) -> DataFrame:
    kw = D.keywords(spark, sf).withColumns({"ranking_url": F.lit(""), "last_checked_at": F.lit(None).cast("timestamp_ntz")})
    k = F.col("keyword_id")
    results = kw.select(
        "keyword_id", (k % 10 != 0).alias("success"), F.when(k % 8 != 0, k * 7 % 100 + 1).cast("int").alias("position"), F.lit("u").alias("url")
    )
    return K.update_rankings(kw, results, F.lit("2024-01-31").cast("timestamp_ntz")).select(
        "keyword_id", "previous_position", "current_position", "best_position"
    )


@query(
    "k06_ranking_state",
    f"""WITH {D.HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY checked_at DESC, check_seq DESC) AS rn FROM hist)
    SELECT keyword_id, max(position) FILTER (rn = 1) AS current_position, max(position) FILTER (rn = 2) AS previous_position,
    min(position) AS best_position, count(*) AS checks, max(checked_at) AS last_checked_at FROM n GROUP BY keyword_id""",
)
def k06s(spark: SparkSession, sf: str) -> DataFrame:
    return K.ranking_state(D.history(spark, sf))


@query("k07_sites_with_tracked", "SELECT DISTINCT c_custkey AS site_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    kw = table(spark, sf, "orders").select(F.col("o_custkey").alias("site_id"), (F.col("o_orderstatus") == "O").alias("is_tracked"))
    return K.sites_with_tracked(table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id")), kw)


@query(
    "k08_track_top",
    f"""WITH {D.KEYWORDS} SELECT site_id, keyword_id, search_volume, row_number() OVER (PARTITION BY site_id ORDER BY search_volume DESC, keyword_id)::INT AS rank
    FROM kw WHERE NOT is_tracked AND search_volume >= 100 QUALIFY rank <= 50""",
)
def k08(spark: SparkSession, sf: str) -> DataFrame:
    return K.track_top(D.keywords(spark, sf)).select("site_id", "keyword_id", "search_volume", "rank")


@query(
    "k08b_set_tracking",
    f"""WITH {D.KEYWORDS} SELECT site_id, keyword_id, is_tracked OR keyword_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AS is_tracked FROM kw""",
)
def k08b(spark: SparkSession, sf: str) -> DataFrame:
    kw = D.keywords(spark, sf)
    listed = table(spark, sf, "lineitem").filter("l_quantity = 50").select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("site_id"), F.col("l_partkey").alias("keyword_id")
    )
    return K.set_tracking(kw, listed, True).select("site_id", "keyword_id", "is_tracked")


_GAPS = f"""{D.KEYWORDS}, {D.RIVALS},
g AS (SELECT site_id, lower(text) AS keyword, arg_min(search_volume, seq) FILTER (seq IS NOT NULL) AS sv0, count(*) AS competitor_count, min(seq) AS s0,
  string_agg(competitor, ',' ORDER BY seq, competitor) AS competitors FROM riv WHERE NOT own GROUP BY ALL),
gf AS (SELECT g.*, r.search_volume, r.difficulty, r.intent FROM g JOIN (SELECT DISTINCT site_id, lower(text) AS keyword, seq, search_volume, difficulty, intent FROM riv WHERE NOT own) r
  ON r.site_id = g.site_id AND r.keyword = g.keyword AND r.seq = g.s0),
gap AS (SELECT site_id, keyword, search_volume, difficulty, intent, competitor_count, competitors,
  search_volume * competitor_count * CASE WHEN difficulty > 0 AND difficulty < 50 THEN 1.5::DOUBLE ELSE 1 END AS priority_score
  FROM gf WHERE search_volume > 50 AND NOT EXISTS (SELECT 1 FROM riv o WHERE o.own AND o.site_id = gf.site_id AND lower(o.text) = gf.keyword)
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY priority_score DESC, keyword) <= 100)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    r = D.rankings_of_sites(spark, sf)
    return K.keyword_gaps(r.filter("own"), r.filter("not own"))


@query("k09_keyword_gaps", f"WITH {_GAPS} SELECT site_id, keyword, search_volume, difficulty, intent, competitor_count, competitors, round(priority_score, 2) AS priority_score FROM gap")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf).select(
        "site_id", "keyword", "search_volume", "difficulty", "intent", "competitor_count",
        F.array_join("competitors", ",").alias("competitors"), F.round("priority_score", 2).alias("priority_score"),
    )


@query(
    "k09_upsert_gaps",
    f"""WITH {_GAPS}, e AS (SELECT site_id, lower(text) AS keyword, min(difficulty) AS difficulty FROM kw GROUP BY ALL)
    SELECT coalesce(e.site_id, g.site_id) AS site_id, coalesce(e.keyword, g.keyword) AS keyword,
    CASE WHEN g.keyword IS NOT NULL THEN g.difficulty ELSE e.difficulty END AS difficulty, g.competitor_count, CASE WHEN e.keyword IS NULL THEN 'new' ELSE 'planned' END AS status
    FROM e FULL JOIN gap g ON e.site_id = g.site_id AND e.keyword = g.keyword""",
)
def k09u(spark: SparkSession, sf: str) -> DataFrame:
    stored = D.keywords(spark, sf).groupBy("site_id", F.lower("text").alias("keyword")).agg(F.min("difficulty").alias("difficulty")).select(
        "site_id", "keyword", F.lit(None).cast("int").alias("search_volume"), "difficulty", F.lit(None).cast("string").alias("intent"),
        F.lit(None).cast("bigint").alias("competitor_count"), F.lit(None).cast("array<string>").alias("competitors"),
        F.lit(None).cast("double").alias("priority_score"), F.lit("planned").alias("status"),
    )
    return K.upsert_gaps(stored, _gaps(spark, sf)).select("site_id", "keyword", "difficulty", "competitor_count", "status")


@query("k10_domain_of", f"WITH {D.SERP} SELECT item_seq, regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/]*)', 1) AS domain FROM serp")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    return D.serp_items(spark, sf).select("item_seq", U.domain_of(F.col("url")).alias("domain"))


@query("k11_list_keywords", f"WITH {D.KEYWORDS} SELECT keyword_id, text, search_volume FROM kw WHERE text ILIKE '%HOTEL%' ORDER BY search_volume DESC NULLS LAST, keyword_id LIMIT 50 OFFSET 50")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    return K.list_keywords(D.keywords(spark, sf), search="HOTEL", page=2).select("keyword_id", "text", "search_volume")


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A cluster per supplier; its keywords are the parts on its order lines."""
    c = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("cluster_id"), F.col("s_name").alias("label"), D._pick(F.col("s_suppkey"), 5, *D.INTENTS, "other").alias("intent")
    )
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("keyword_id"), D.line_seq().alias("seq"))
    # a cluster lies in few tasks, so that partial counts and first rows of a cluster stay few, and in more than one
    dealt = finer(lines.withColumn("part", F.pmod(F.xxhash64("keyword_id"), F.lit(16))), "cluster_id", "part")
    m = dealt.groupBy("cluster_id", "part", "keyword_id").agg(F.min("seq").alias("seq")).drop("part")
    return c, m


_CL = f"""{D.KEYWORDS}, cl AS (SELECT s_suppkey AS cluster_id, s_name AS label, CASE s_suppkey % 5 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(D.INTENTS))} ELSE 'other' END AS intent FROM supplier),
mem AS (SELECT l_suppkey AS cluster_id, l_partkey AS keyword_id, min({D._SEQ}) AS seq FROM lineitem GROUP BY ALL),
ck AS (SELECT mem.*, text, search_volume FROM mem JOIN kw USING (keyword_id))"""


@query(
    "k12_cluster_stats",
    f"""WITH {_CL} SELECT cluster_id, label, count(text) AS keyword_count, coalesce(sum(search_volume), 0)::BIGINT AS total_volume FROM cl LEFT JOIN ck USING (cluster_id) GROUP BY ALL""",
)
def k12(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _clusters(spark, sf)
    return K.cluster_stats(c.drop("intent"), m, D.keywords(spark, sf))


@query("k13_ranking_history", f"WITH {D.HISTORY} SELECT check_seq, checked_at, position FROM hist WHERE keyword_id = 7 AND checked_at >= TIMESTAMP '2001-08-01' - INTERVAL 900 DAY")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    return K.ranking_history(D.history(spark, sf), 7, 900, F.lit("2001-08-01").cast("timestamp_ntz")).select("check_seq", "checked_at", "position")


@query(
    "k14_rankings_summary",
    f"""WITH {D.KEYWORDS} SELECT site_id, count(*) AS total_tracked, count_if(current_position <= 3) AS in_top_3, count_if(current_position <= 10) AS in_top_10,
    count_if(current_position IS NULL) AS not_ranking, count_if(current_position < previous_position) AS improved,
    count_if(current_position > previous_position) AS declined, round(avg(current_position), 1) AS average_position FROM kw WHERE is_tracked GROUP BY site_id""",
)
def k14(spark: SparkSession, sf: str) -> DataFrame:
    return K.rankings_summary(D.keywords(spark, sf))


@query(
    "k15_ranking_changes",
    f"""WITH {D.KEYWORDS}, c AS (SELECT site_id, keyword_id, current_position, previous_position, previous_position - current_position AS change,
      CASE WHEN current_position < previous_position THEN 'improved' WHEN current_position > previous_position THEN 'declined'
      WHEN current_position IS NOT NULL AND previous_position IS NULL THEN 'new' WHEN current_position IS NULL AND previous_position IS NOT NULL THEN 'lost' END AS change_type
      FROM kw WHERE is_tracked)
    SELECT *, row_number() OVER (PARTITION BY site_id, change_type ORDER BY CASE change_type WHEN 'new' THEN current_position WHEN 'lost' THEN previous_position ELSE -abs(change) END, keyword_id)::INT AS rank
    FROM c WHERE change_type IS NOT NULL QUALIFY rank <= 20""",
)
def k15(spark: SparkSession, sf: str) -> DataFrame:
    return K.ranking_changes(D.keywords(spark, sf))


@query("k16_position_change", f"WITH {D.KEYWORDS} SELECT keyword_id, previous_position - current_position AS change FROM kw")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    return D.keywords(spark, sf).select("keyword_id", X.position_change(F.col("previous_position"), F.col("current_position")).alias("change"))


@query(
    "k17_intent_clusters",
    f"""WITH {D.KEYWORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY coalesce(search_volume, 0)::DOUBLE / greatest(coalesce(nullif(difficulty, 0), 1), 1) DESC, keyword_id) AS rn FROM kw)
    SELECT site_id, coalesce(intent, 'informational') AS intent, upper(left(coalesce(intent, 'informational'), 1)) || substr(coalesce(intent, 'informational'), 2) || ' Keywords' AS name,
      array_to_string((list(text ORDER BY rn))[1:10], ',') AS keywords, sum(coalesce(search_volume, 0))::BIGINT AS total_volume FROM b GROUP BY ALL""",
)
def k17(spark: SparkSession, sf: str) -> DataFrame:
    return K.intent_clusters(D.keywords(spark, sf)).select("site_id", "intent", "name", F.array_join("keywords", ",").alias("keywords"), "total_volume")


_TOPICS, _ROUNDS = 8, 5


def _topic_sql(rows: str) -> str:
    """Topics over all sites at once.  rows: CTEs that end with ids (site_id, keyword_id) and x (site_id, keyword_id, i, v)."""
    apart = """SELECT q.site_id, q.keyword_id, z.k, (q.norm + z.norm - 2 * coalesce(sum(x.v * c.v), 0))::BIGINT AS d
      FROM sq q JOIN n{n} z USING (site_id) LEFT JOIN x USING (site_id, keyword_id) LEFT JOIN c{n} c ON c.site_id = q.site_id AND c.k = z.k AND c.i = x.i GROUP BY q.site_id, q.keyword_id, q.norm, z.k, z.norm"""
    norm = "n{n} AS MATERIALIZED (SELECT s.site_id, s.k, coalesce(sum(v * v), 0) AS norm FROM s{n} s LEFT JOIN c{n} USING (site_id, k) GROUP BY s.site_id, s.k)"
    steps = [
        "sizes AS (SELECT site_id, count(*) AS n FROM ids GROUP BY site_id)",
        "sq AS MATERIALIZED (SELECT site_id, keyword_id, coalesce(sum(v * v), 0) AS norm FROM ids JOIN sizes USING (site_id) LEFT JOIN x USING (site_id, keyword_id) WHERE n >= 3 GROUP BY site_id, keyword_id)",
        "t0 AS (SELECT site_id, min(keyword_id) AS keyword_id, 0 AS k FROM sq GROUP BY site_id)",
        "s0 AS MATERIALIZED (SELECT site_id, k, keyword_id FROM t0)",
        "c0 AS MATERIALIZED (SELECT site_id, k, i, v FROM s0 JOIN x USING (site_id, keyword_id))",
        norm.format(n=0),
    ]
    for n in range(1, _TOPICS):
        steps += [
            f"f{n} AS (SELECT site_id, keyword_id, min(d) AS least FROM ({apart.format(n=n - 1)}) GROUP BY site_id, keyword_id)",
            f"s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL SELECT site_id, {n} AS k, keyword_id FROM f{n} WHERE least > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY least DESC, keyword_id) = 1)",
            f"c{n} AS MATERIALIZED (SELECT site_id, k, i, v FROM s{n} JOIN x USING (site_id, keyword_id))",
            norm.format(n=n),
        ]
    last = _TOPICS - 1
    for n in range(last, last + _ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT site_id, keyword_id, k FROM ({apart.format(n=n)}) QUALIFY row_number() OVER (PARTITION BY site_id, keyword_id ORDER BY d, k) = 1)")
        if n < last + _ROUNDS:
            steps += [
                f"m{n} AS (SELECT site_id, k, count(*) AS n FROM a{n} GROUP BY site_id, k)",
                f"g{n} AS (SELECT site_id, k, i, sum(v)::BIGINT AS s, any_value(n) AS n FROM a{n} JOIN m{n} USING (site_id, k) JOIN x USING (site_id, keyword_id) GROUP BY site_id, k, i)",
                f"s{n + 1} AS MATERIALIZED (SELECT * FROM s{n})",
                f"c{n + 1} AS MATERIALIZED (SELECT site_id, k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM g{n} UNION ALL SELECT * FROM c{n} c ANTI JOIN m{n} USING (site_id, k))",
                norm.format(n=n + 1),
            ]
    return f"""WITH {rows}, {", ".join(steps)}
    SELECT site_id, keyword_id, 'topic_' || k AS cluster_label FROM a{last + _ROUNDS}
    UNION ALL SELECT site_id, keyword_id, 'mixed' FROM ids JOIN sizes USING (site_id) WHERE n < 3"""


_VECTORS = f"""v AS (SELECT CASE WHEN vec_id IN (98, 198) THEN 'few' ELSE 's' || (vec_id % 5) END AS site_id, vec_id AS keyword_id, embedding FROM embeddings),
  ids AS (SELECT site_id, keyword_id FROM v), x AS MATERIALIZED (SELECT site_id, keyword_id, i, floor({T.SCALE} * embedding[i]::DOUBLE)::BIGINT AS v FROM v, unnest(range(1, len(embedding) + 1)) u(i))"""


@query("k18_topic_clusters", _topic_sql(_VECTORS))
def k18(spark: SparkSession, sf: str) -> DataFrame:
    """Topics over the embedding vectors; a site of two keywords stays mixed."""
    e = table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id").isin(98, 198), "few").otherwise(F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string"))).alias("site_id"),
        F.col("vec_id").alias("keyword_id"), "embedding",
    )
    return T.topic_clusters(e, _TOPICS, _ROUNDS, "embedding", 64)


_WORDS = f"""{D.KEYWORDS}, ids AS (SELECT site_id, keyword_id FROM kw),
  w AS (SELECT site_id, keyword_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS word FROM kw),
  tf AS (SELECT site_id, keyword_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % {T.DIMS} AS i, count(*) AS tf FROM w GROUP BY ALL),
  x AS MATERIALIZED (SELECT site_id, keyword_id, i, floor({T.SCALE} * tf * ln((n + 1) / (df + 1)) + 0.5)::BIGINT AS v
    FROM tf JOIN (SELECT site_id, i, count(*) AS df FROM tf GROUP BY ALL) USING (site_id, i) JOIN (SELECT site_id, count(*) AS n FROM ids GROUP BY site_id) USING (site_id))"""


@query("k18_topic_clusters_text", _topic_sql(_WORDS))
def k18t(spark: SparkSession, sf: str) -> DataFrame:
    """Topics over TF-IDF of the keyword texts."""
    return T.topic_clusters(D.keywords(spark, sf).select("site_id", "keyword_id", "text"), _TOPICS, _ROUNDS)


_FMT = "CASE intent WHEN 'informational' THEN 'Blog post or guide' WHEN 'transactional' THEN 'Product page or landing page' WHEN 'commercial' THEN 'Comparison or review article' WHEN 'navigational' THEN 'Category or pillar page' ELSE 'Blog post' END"


@query(
    "k19_keyword_strategy",
    f"""WITH {_CL} SELECT cluster_id, label, intent, count(text) AS keyword_count, coalesce(floor(avg(coalesce(search_volume, 0)) FILTER (text IS NOT NULL)), 0)::BIGINT AS avg_search_volume,
    coalesce(array_to_string((list(text ORDER BY seq, keyword_id) FILTER (text IS NOT NULL))[1:5], ','), '') AS top_keywords, {_FMT} AS suggested_format
    FROM cl LEFT JOIN ck USING (cluster_id) GROUP BY ALL""",
)
def k19(spark: SparkSession, sf: str) -> DataFrame:
    c, m = _clusters(spark, sf)
    return K.keyword_strategy(c, m, D.keywords(spark, sf)).withColumn("top_keywords", F.array_join("top_keywords", ","))


@query(
    "k19_priority_keywords",
    f"""WITH {D.KEYWORDS} SELECT site_id, keyword_id, search_volume, row_number() OVER (PARTITION BY site_id ORDER BY coalesce(search_volume, 0) DESC, keyword_id)::INT AS rank FROM kw QUALIFY rank <= 10""",
)
def k19p(spark: SparkSession, sf: str) -> DataFrame:
    return K.priority_keywords(D.keywords(spark, sf)).select("site_id", "keyword_id", "search_volume", "rank")


@query(
    "k20_serp_content_types",
    f"""WITH {D.SERP}, f AS (SELECT keyword, bool_or(regexp_matches(lower(url), 'blog|article')) AS a, bool_or(regexp_matches(lower(title), 'guide|how to')) AS b,
      bool_or(contains(lower(title), 'review')) AS c, bool_or(regexp_matches(lower(title), 'best|top')) AS d, bool_or(regexp_matches(lower(title), 'vs|versus')) AS e FROM serp WHERE type = 'organic' GROUP BY keyword)
    SELECT keyword, coalesce(nullif(array_to_string([x for x in [CASE WHEN a THEN 'Blog post' END, CASE WHEN b THEN 'Guide/Tutorial' END, CASE WHEN c THEN 'Review' END,
      CASE WHEN d THEN 'List/Roundup' END, CASE WHEN e THEN 'Comparison' END] if x IS NOT NULL], ','), ''), 'Article') AS content_types FROM f""",
)
def k20(spark: SparkSession, sf: str) -> DataFrame:
    r = K.serp_content_types(D.serp_items(spark, sf).filter("type = 'organic'"))
    return r.select("keyword", F.array_join("content_types", ",").alias("content_types"))


@query(
    "k21_keyword_report",
    f"""WITH {D.KEYWORDS}, t AS (SELECT site_id, count(*) AS keywords_found, sum(coalesce(search_volume, 0))::BIGINT AS total_volume FROM kw GROUP BY site_id)
    SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY coalesce(search_volume, 0) DESC, keyword_id)::INT AS rank, left(text, 40) AS text,
      coalesce(search_volume, 0) AS search_volume, difficulty, intent, keywords_found, total_volume FROM kw JOIN t USING (site_id) QUALIFY rank <= 30""",
)
def k21(spark: SparkSession, sf: str) -> DataFrame:
    return K.keyword_report(D.keywords(spark, sf))


@query(
    "k22_bands",
    f"""WITH {D.KEYWORDS} SELECT keyword_id, CASE WHEN search_volume >= 10000 THEN 'high' WHEN search_volume >= 1000 THEN 'medium' WHEN search_volume >= 100 THEN 'low' ELSE 'very_low' END AS volume_band,
    CASE WHEN competition >= 0.7::DOUBLE THEN 'high' WHEN competition >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS competition_band FROM kw""",
)
def k22(spark: SparkSession, sf: str) -> DataFrame:
    return D.keywords(spark, sf).select(
        "keyword_id", X.volume_band(F.col("search_volume")).alias("volume_band"), X.competition_band(F.col("competition")).alias("competition_band")
    )
