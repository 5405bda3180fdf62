"""Lookups, counts and rewrites of a store of units: by id, kind, time, session and status; soft and hard deletes; date ranges."""

from turnloom.sql import Query

STATUS = "unit AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'PINNED' WHEN l.quality = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
SPANS = "span AS (SELECT o_custkey, o_orderkey, {epoch(o_orderdate)} AS lo_s, {epoch(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))} AS hi_s FROM orders)"
BETA = "b AS (SELECT event_type, 1e0 + sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS alpha, 1e0 + sum(CASE WHEN value >= 100 THEN 0 ELSE 1 END) AS beta FROM events GROUP BY event_type)"
NEXT = "two AS (SELECT a.vec_id, {dot(a.embedding;b.embedding)} AS ab, {dot(a.embedding;a.embedding)} AS aa, {dot(b.embedding;b.embedding)} AS bb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"

QUERIES = [
    Query("o047_delete_units", "SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)"),
    Query("o048_archive_units", f"WITH {STATUS} SELECT doc_id, CASE WHEN status <> 'PINNED' AND n_chars < 500 THEN 'ARCHIVED' ELSE status END AS status, CASE WHEN status <> 'PINNED' AND n_chars < 500 THEN 'COLD' ELSE 'HOT' END AS tier FROM unit"),
    Query("o060_update_importance", "SELECT d.doc_id, coalesce(CAST(l.quality AS double), 0.5) AS importance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0"),
    Query("o061_clear_tenant", "SELECT event_id, user_id, event_type FROM events WHERE NOT coalesce(user_id = 3, false)"),
    Query("o079_valuable_of_kinds", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND CASE event_type WHEN 'error' THEN {json_int(props;k)} IS NOT NULL ELSE value > 0 END"),
    Query("o081_unit_by_id", "SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 7"),
    Query("o082_units_in_request_order", "SELECT w.pos, d.doc_id, d.source FROM (VALUES (0, 42), (1, 7), (2, 99), (3, 7), (4, -1)) AS w(pos, id) JOIN documents d ON d.doc_id = w.id"),
    Query("o083_active_units", f"WITH {STATUS} SELECT doc_id, source FROM unit WHERE status = 'ACTIVE' ORDER BY doc_id LIMIT 100"),
    Query("o084_units_in_time_range", "SELECT event_id, event_type, {epoch(ts)} AS at_s FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-31 23:59:59' AND event_type = 'view' ORDER BY ts, event_id"),
    Query("o085_units_by_modality", "SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 100"),
    Query("o086_units_of_event", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 5"),
    Query("o089_open_events", f"WITH {SPANS} SELECT o_custkey, o_orderkey, lo_s FROM span WHERE hi_s IS NULL"),
    Query("o090_events_of_session", "SELECT event_id, event_type, value FROM events WHERE user_id = 5"),
    Query("o092_nodes_of_type", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100"),
    Query("o094_entity_by_name", """
        WITH k AS (SELECT lower(trim(p_name)) AS name, 0 AS tier, p_partkey AS id FROM part UNION ALL SELECT lower(trim(p_brand)) AS name, 1 AS tier, p_partkey AS id FROM part)
        SELECT name, id, tier FROM (SELECT name, id, tier, row_number() OVER (PARTITION BY name ORDER BY tier, id) AS rnk FROM k) w WHERE rnk = 1"""),
    Query("o127_bridge_edges", """
        WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
        SELECT e.s, e.p FROM e JOIN supplier ON s_suppkey = e.s JOIN part ON p_partkey = e.p WHERE s_nationkey < 5 AND p_size <= 5"""),
    Query("o130_event_with_units", """
        SELECT o.o_orderkey, o.o_orderstatus, count(l.l_partkey) AS units_, {joined({collect(CAST(l.l_partkey AS varchar(20));l.l_partkey)}; )} AS parts
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_orderstatus"""),
    Query("o138_children", "SELECT p.conv_id, p.turn AS parent_turn, c.turn AS child_turn FROM conversations p JOIN conversations c ON p.conv_id = c.conv_id AND c.turn = p.turn + 1"),
    Query("o186_store_counts", "SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions_, (SELECT count(*) FROM conversations WHERE role = 'user') AS messages_, (SELECT count(*) FROM labels WHERE quality = 1) AS good_, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors_"),
    Query("o188_tool_summary", "SELECT event_id, event_type AS tool, {json_int(props;k)} AS target FROM events WHERE event_type IN ('click', 'purchase')"),
    Query("o189_count_by_modality", "SELECT source, count(*) AS n FROM documents GROUP BY source"),
    Query("o190_count_by_status", f"WITH {STATUS} SELECT status, count(*) AS n FROM unit GROUP BY status"),
    Query("o191_count_by_session", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id"),
    Query("o236_most_important", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100"),
    Query("o237_to_forget", "SELECT event_id, value FROM events WHERE value < 50 ORDER BY event_id LIMIT 100"),
    Query("o239_strategy_ranking", f"WITH {BETA} SELECT event_type, alpha / (alpha + beta) AS mean_, row_number() OVER (ORDER BY alpha / (alpha + beta) DESC, event_type) AS rnk FROM b"),
    Query("o240_most_recent", "SELECT event_id, {epoch(ts)} AS at_s FROM events ORDER BY ts DESC, event_id DESC LIMIT 10"),
    Query("o330_truncated", "SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 80) || '...' END AS shown FROM conversations"),
    Query("o340_day_range", "SELECT event_id, {epoch(date_trunc('day', ts))} - 86400 AS lo_s, {epoch(date_trunc('day', ts))} AS hi_s FROM events"),
    Query("o342_month_range", "SELECT event_id, {epoch(date_trunc('month', ts))} - 30 * 86400 AS lo_s, {epoch(date_trunc('month', ts))} AS hi_s FROM events"),
    Query("o343_valid_from", "SELECT o_orderkey, {epoch(TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE CAST(o_orderdate AS varchar(40)) END AS timestamp))} AS at_s FROM orders"),
    Query("o344_cosine_of_next", f"WITH {NEXT} SELECT vec_id, CASE WHEN aa = 0 OR bb = 0 THEN 0.0 ELSE round(ab / (sqrt(aa) * sqrt(bb)), 6) END AS cosine FROM two"),
    Query("o346_dot_of_unit_vectors", f"WITH {NEXT} SELECT vec_id, round(ab / sqrt(CASE WHEN aa = 0 THEN 1 ELSE aa END) / sqrt(CASE WHEN bb = 0 THEN 1 ELSE bb END), 6) AS similarity FROM two"),
    Query("o353_beta_variance", f"WITH {BETA} SELECT event_type, alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)) AS variance FROM b"),
    Query("o455_events_with_units", "SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    Query("o457_at_level", "SELECT conv_id, turn, role FROM conversations WHERE CAST(floor(turn / 4.0) AS bigint) = 1"),
]
