"""Filters, projections and lookups: conjunctive, tenant-like, interval, membership and paging predicates."""

from turnloom.sql import Query

QUERIES = [
    Query("o071_conjunctive_search", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error') AND value BETWEEN 50 AND 150 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'"),
    Query("o074_absent_value_passes", "SELECT doc_id, lang, source FROM documents WHERE (lang IS NULL OR lower(lang) IN ('en', 'de'))"),
    Query("o076_list_page", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100"),
    Query("o077_events_of_kinds", "SELECT user_id, event_id, {epoch(ts)} AS at_s FROM events WHERE event_type IN ('click', 'view')"),
    Query("o080_valuable_events", "SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'error' THEN {json_int(props;k)} IS NOT NULL WHEN 'purchase' THEN value > 0 ELSE {json_int(props;k)} > 10 END"),
    Query("o087_light_projection", "SELECT page_id, url, length(html) AS n FROM pages"),
    Query("o088_interval_overlap", """
        WITH spans AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hi FROM orders)
        SELECT o_custkey, o_orderkey, hi IS NULL AS still_open FROM spans WHERE lo >= TIMESTAMP '1995-01-01 00:00:00' AND (hi IS NULL OR lo <= TIMESTAMP '1996-01-01 00:00:00')"""),
    Query("o091_array_contains", "SELECT doc_id, {size({words(text)})} AS n FROM documents WHERE {has({words(text)};tion)}"),
    Query("o093_name_search", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%brand#1%' ORDER BY p_retailprice DESC, p_partkey LIMIT 10"),
    Query("o096_answerable", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 AND l.quality IN (0, 1)"),
    Query("o097_keep_last_sessions", """
        WITH r AS (SELECT conv_id, turn, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY CAST(floor(turn / 4.0) AS bigint) DESC) AS back FROM conversations)
        SELECT conv_id, turn, role FROM r WHERE back <= 2"""),
    Query("o098_contentful_turns", "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 8 AND lower(trim(text)) NOT IN ('hello there', 'good morning', 'thank you')"),
    Query("o099_contiguous_shards", """
        WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
        SELECT source, doc_id, CAST(floor(pos / ceil(n / 4.0)) AS bigint) AS shard FROM r"""),
    Query("o213_first_occurrences", """
        SELECT conv_id, tok, pos FROM (SELECT conv_id, tok, turn * 100000 + pos AS pos, row_number() OVER (PARTITION BY conv_id, tok ORDER BY turn, pos) AS rnk FROM (SELECT conv_id, turn, tok, pos FROM conversations {posexplode({words(text)})}) x) w WHERE rnk = 1"""),
    Query("o456_roots", "SELECT DISTINCT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)"),
]
