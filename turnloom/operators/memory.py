"""Memory maintenance: decay, pruning, soft deletes, version history, upserts as rewrites."""

from turnloom.sql import Query

QUERIES = [
    Query("o349_importance_decay", "SELECT event_id, user_id, {days(ts;TIMESTAMP '2024-02-01 00:00:00')} AS age_days, {days(ts;TIMESTAMP '2024-02-01 00:00:00')} > 20 AS decayed FROM events"),
    Query("x_prune_low_importance", "SELECT event_id, user_id, value FROM events WHERE NOT (value < 20 AND {days(ts;TIMESTAMP '2024-02-01 00:00:00')} > 10)"),
    Query("x_scd2_history", """
        SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders"""),
    Query("x_upsert_rewrite", """
        WITH fresh AS (SELECT doc_id, 'audited' AS lang FROM labels WHERE toxic = 1)
        SELECT d.doc_id, coalesce(f.lang, d.lang) AS lang, f.doc_id IS NOT NULL AS changed FROM documents d LEFT JOIN fresh f ON d.doc_id = f.doc_id"""),
    Query("x_soft_delete", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN NULL ELSE min(doc_id) OVER (PARTITION BY text) END AS superseded_by FROM documents"),
    Query("x_structured_filter", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND turn BETWEEN 1 AND 4 AND (lower(text) LIKE '%tion%' OR length(text) < 80) ORDER BY conv_id, turn"),
    Query("x_content_ids", "SELECT conv_id, turn, substr({sha1(text)}, 1, 12) AS content_id, trim({replace(text;[^A-Za-z ])}) AS plain FROM conversations"),
]
