"""Joins: equi, outer, semi, anti, band, interval, as-of and conflict joins."""

from turnloom.sql import Query

QUERIES = [
    Query("o102_inner_join", "SELECT o.o_orderkey, c.c_custkey, n.n_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000"),
    Query("o116_left_overlay", "SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS audited FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    Query("o110_full_outer_alignment", """
        WITH u AS (SELECT conv_id, count(*) AS n_user FROM conversations WHERE role = 'user' GROUP BY conv_id), s AS (SELECT conv_id, count(*) AS n_system FROM conversations WHERE role = 'system' GROUP BY conv_id)
        SELECT coalesce(u.conv_id, s.conv_id) AS conv_id, coalesce(n_user, 0) AS n_user, coalesce(n_system, 0) AS n_system, CASE WHEN u.conv_id IS NULL THEN 'right' WHEN s.conv_id IS NULL THEN 'left' ELSE 'both' END AS side FROM u FULL OUTER JOIN s ON u.conv_id = s.conv_id"""),
    Query("o114_leak_semi_join", """
        WITH b AS (SELECT DISTINCT tok FROM benchmark {explode({words(text)})} WHERE length(tok) >= 12)
        SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM (SELECT conv_id AS i, turn AS t2, tok FROM conversations {explode({words(text)})}) x JOIN b ON x.tok = b.tok WHERE x.i = c.conv_id AND x.t2 = c.turn)"""),
    Query("o106_resume_anti_join", "SELECT d.doc_id, d.source FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id"),
    Query("o129_time_band", """
        WITH e AS (SELECT event_id, user_id, event_type, {epoch(ts)} AS s, CAST(floor({epoch(ts)} / 3600.0) AS bigint) AS hour_ FROM events),
        a AS (SELECT event_id, user_id, s, hour_ FROM e WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, s, hour_ + 1 AS hour_ FROM e WHERE event_type = 'error')
        SELECT a.event_id, b.event_id AS other_id, a.user_id, b.s - a.s AS seconds_apart FROM a JOIN e b ON a.user_id = b.user_id AND a.hour_ = b.hour_ WHERE b.event_id > a.event_id AND b.s - a.s BETWEEN 0 AND 3600"""),
    Query("x_as_of_event", """
        SELECT event_id, user_id, prior_purchase FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_purchase FROM events) w WHERE event_type = 'error'"""),
    Query("o125_conflict_pairs", """
        WITH latest AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey, o_orderstatus)
        SELECT a.o_custkey, a.o_orderstatus AS status_a, b.o_orderstatus AS status_b, a.first_key AS key_a, b.first_key AS key_b FROM latest a JOIN latest b ON a.o_custkey = b.o_custkey AND a.o_orderstatus < b.o_orderstatus"""),
    Query("o168_completeness_grid", """
        WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), have AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)
        SELECT l.lang, s.source, coalesce(h.n, 0) AS n FROM l CROSS JOIN s LEFT JOIN have h ON h.lang = l.lang AND h.source = s.source"""),
    Query("o425_positional_zip", """
        WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS pos FROM conversations)
        SELECT a.conv_id, a.pos, a.turn AS expected, b.turn AS found FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos WHERE a.turn <> b.turn"""),
]
QUERIES = [q if q.name != "o106_resume_anti_join" else Query(q.name, "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)") for q in QUERIES]
