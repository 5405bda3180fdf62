"""Grouped statistics and metrics: spread, percentiles, accuracy, concentration, capped sums, merges of duplicates."""

from turnloom.plans.evaluation import PAIRED
from turnloom.sql import Query

QUERIES = [
    Query("o104_joined_counts", "SELECT c.c_mktsegment, count(*) AS n, count(DISTINCT c.c_custkey) AS customers FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment"),
    Query("o105_two_tier_key", """
        WITH named AS (SELECT trim(lower(d.text)) AS t, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
        uniq AS (SELECT t, min(quality) AS quality FROM named GROUP BY t HAVING count(*) = 1)
        SELECT d.doc_id, coalesce(l.quality, o.quality) AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 'key' WHEN o.t IS NOT NULL THEN 'text' ELSE 'none' END AS tier
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN uniq o ON trim(lower(d.text)) = o.t"""),
    Query("o108_alignment_errors", """
        WITH li AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
        SELECT coalesce(o.o_orderkey, li.l_orderkey) AS orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'extra' WHEN li.l_orderkey IS NULL THEN 'missing' ELSE 'small' END AS problem
        FROM orders o FULL OUTER JOIN li ON o.o_orderkey = li.l_orderkey WHERE o.o_orderkey IS NULL OR li.l_orderkey IS NULL OR li.q < 20"""),
    Query("o109_evidence_origins", """
        WITH origin AS (SELECT DISTINCT l.l_orderkey, n.n_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)
        SELECT l_orderkey, {joined({collect(n_name;n_name)};|)} AS origins, count(*) AS n FROM origin GROUP BY l_orderkey"""),
    Query("o144_spread_by_group", "SELECT lang, count(*) AS n, round(avg(CAST(n_chars AS double)), 6) AS mean, round(coalesce(stddev_samp(CAST(n_chars AS double)), 0), 6) AS sd, {quantile(n_chars;0.5)} AS median_, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang"),
    Query("o156_numeric_summary", "SELECT min(length(html)) AS lo, max(length(html)) AS hi, round(avg(CAST(length(html) AS double)), 2) AS mean, CAST(sum(length(html)) AS bigint) AS total, count(*) AS n FROM pages"),
    Query("o162_nearest_rank", """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, max(CASE WHEN pos = CAST(floor(n * 0.5) AS bigint) THEN value END) AS p50, max(CASE WHEN pos = CAST(floor(n * 0.95) AS bigint) THEN value END) AS p95, max(CASE WHEN pos = CAST(floor(n * 0.99) AS bigint) THEN value END) AS p99 FROM r GROUP BY event_type"""),
    Query("o172_flag_score", """
        SELECT doc_id, (CASE WHEN n_chars < 100 THEN 2 ELSE 0 END) + (CASE WHEN lang IS NULL THEN 1 ELSE 0 END) + (CASE WHEN {matches(text;[0-9][0-9][0-9])} THEN 1 ELSE 0 END) + (CASE WHEN copies > 1 THEN 3 ELSE 0 END) AS score
        FROM (SELECT doc_id, text, lang, n_chars, count(*) OVER (PARTITION BY text) AS copies FROM documents) d"""),
    Query("o173_graded_accuracy", f"""
        WITH {PAIRED}, t AS (SELECT conv_id, turn, lower(trim(gold_text)) AS g, lower(trim(said_text)) AS s FROM pair)
        SELECT conv_id, count(*) AS n, sum(CASE WHEN g = s THEN CAST(1 AS double) WHEN contains(g, s) OR contains(s, g) THEN CAST(0.5 AS double) ELSE CAST(0 AS double) END) AS score FROM t GROUP BY conv_id"""),
    Query("o176_token_efficiency", f"""
        WITH {PAIRED} SELECT conv_id, 1 - CAST(sum({{size(said)}}) AS double) / sum({{size(gold)}}) AS efficiency FROM pair GROUP BY conv_id HAVING sum({{size(gold)}}) > 0"""),
    Query("o185_recent_success", """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events)
        SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS double) / count(*) AS rate, round(avg(value), 6) AS mean FROM r WHERE back <= 100 GROUP BY event_type"""),
    Query("o187_session_value", """
        WITH k AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS buys, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
        SELECT user_id, kinds, round(CAST(least(1, 0.1 + least(0.02 * views, 0.3) + least(0.08 * clicks, 0.5) + least(0.12 * buys, 0.5) + CASE WHEN kinds >= 3 THEN 0.1 ELSE 0 END) AS double), 6) AS worth FROM k"""),
    Query("o192_stats_by_type", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands, max(p_size) AS largest, min(p_retailprice) AS cheapest FROM part GROUP BY p_type"),
    Query("o193_entity_merge", "SELECT lower(source) AS entity, count(*) AS mentions, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(DISTINCT lang) AS aliases FROM documents GROUP BY lower(source)"),
    Query("o194_relation_dedupe", "SELECT l_suppkey AS s, l_partkey AS o, count(*) AS n, max(l_discount) AS confidence, count(DISTINCT l_orderkey) AS units FROM lineitem GROUP BY l_suppkey, l_partkey"),
    Query("o196_gini", """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value >= 0)
        SELECT event_type, round(sum((2 * i - n - 1) * value) / (max(n) * sum(value)), 6) AS gini FROM r GROUP BY event_type HAVING sum(value) > 0"""),
    Query("o197_entropy", """
        WITH c AS (SELECT role, tok, CAST(count(*) AS double) AS n FROM conversations {explode({words(text)})} GROUP BY role, tok), p AS (SELECT role, n / sum(n) OVER (PARTITION BY role) AS p FROM c)
        SELECT role, count(*) AS distinct_words, round(-sum(p * ln(p) / ln(2)), 6) AS bits FROM p GROUP BY role"""),
    Query("o199_bytes_by_kind", "SELECT source, count(*) AS files, CAST(sum(octet_length({bytes(text)})) AS bigint) AS bytes_ FROM documents WHERE text IS NOT NULL GROUP BY source"),
    Query("o205_top_terms", """
        WITH t AS (SELECT conv_id, tok, count(*) AS n, min(turn * 100000 + pos) AS first_pos FROM (SELECT conv_id, turn, tok, pos FROM conversations {posexplode({words(text)})}) x WHERE length(tok) >= 4 GROUP BY conv_id, tok)
        SELECT conv_id, tok, n, rnk FROM (SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_pos) AS rnk FROM t) w WHERE rnk <= 12"""),
    Query("o352_beta_posterior", """
        WITH w AS (SELECT user_id, 1 + sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS a, 1 + sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS b FROM events GROUP BY user_id)
        SELECT user_id, CAST(a AS double) / (a + b) AS mean, round(CAST(a AS double) * b / (CAST(a + b AS double) * (a + b) * (a + b + 1)), 12) AS variance FROM w"""),
    Query("o390_archive_or_strengthen", """
        WITH s AS (SELECT user_id, CAST(count(*) AS double) AS n, max({epoch(ts)}) AS seen FROM events GROUP BY user_id), t AS (SELECT max(seen) AS now_ FROM s)
        SELECT user_id, n, CASE WHEN n < 5 OR now_ - seen > 604800 THEN 'archive' WHEN n > 20 THEN 'strengthen' ELSE 'keep' END AS action, CASE WHEN n > 20 THEN least(n * 1.1, 2 * n) ELSE n END AS weight FROM s CROSS JOIN t"""),
    Query("o454_parent_spans", "SELECT o_custkey, min(o_orderdate) AS start_, max(o_orderdate) AS end_, count(*) AS children FROM orders GROUP BY o_custkey"),
]
