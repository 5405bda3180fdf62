"""Windows: ranking, running and rolling frames, count windows, gaps, linked rows."""

from turnloom.sql import Query

QUERIES = [
    Query("o368_count_window", """
        WITH pos AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        placed AS (SELECT user_id, event_id, CAST(floor(p / 38.0) AS bigint) AS w FROM pos UNION ALL SELECT user_id, event_id, CAST(floor(p / 38.0) AS bigint) - 1 FROM pos WHERE p % 38 < 2 AND p >= 38)
        SELECT user_id, w AS window_no, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM placed GROUP BY user_id, w"""),
    Query("o378_rolling_percentile", """
        WITH r AS (SELECT user_id, event_id, {quantile(value;0.2)} OVER w AS q, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
        SELECT user_id, event_id, round(q, 6) AS p20 FROM r WHERE n >= 10"""),
    Query("o382_latched_breaker", """
        WITH m AS (SELECT user_id, event_id, ts, avg(value) OVER w AS mean20, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
        t AS (SELECT user_id, event_id, max(CASE WHEN n = 20 AND mean20 < 95 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tripped FROM m)
        SELECT user_id, event_id, tripped FROM t"""),
    Query("x_first_last", "SELECT DISTINCT conv_id, first_value(role) OVER w AS first_role, last_value(role) OVER w AS last_role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    Query("x_linked_rows", "SELECT event_id, user_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    Query("x_dense_rank", "SELECT doc_id, lang, dense_rank() OVER (PARTITION BY lang ORDER BY n_chars DESC) AS rnk FROM documents"),
    Query("x_ntile", "SELECT vec_id, label, ntile(4) OVER (PARTITION BY label ORDER BY vec_id) AS quarter FROM embeddings"),
    Query("x_gap_sessions", """
        WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {epoch(ts)} - lag({epoch(ts)}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, event_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM g)
        SELECT user_id, CAST(no AS bigint) AS no, count(*) AS n, min(event_id) AS first_id, max({epoch(ts)}) - min({epoch(ts)}) AS seconds_ FROM s GROUP BY user_id, no"""),
    Query("x_keep_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rnk FROM orders) w WHERE rnk = 1"),
    Query("x_running_total", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS chars_so_far FROM conversations"),
]
