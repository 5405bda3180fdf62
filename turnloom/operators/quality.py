"""Data-quality gates: each returns the rows that break a rule, or the figures of a release report."""

from turnloom.sql import Query

QUERIES = [
    Query("x_turn_order", "SELECT conv_id, turn, prev FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) w WHERE prev IS NOT NULL AND turn <> prev + 1"),
    Query("x_duplicate_keys", "SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1"),
    Query("x_foreign_keys", "SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)"),
    Query("x_role_domain", "SELECT role, count(*) AS n, role IN ('user', 'assistant', 'system') AS allowed FROM conversations GROUP BY role"),
    Query("x_length_mismatch", "SELECT doc_id, n_chars, length(text) AS measured FROM documents WHERE n_chars <> length(text)"),
    Query("x_hash_recheck", "SELECT page_id, {sha1(html)} AS raw_hash, {matches(html;<title>)} AS has_title, length(html) AS n FROM pages"),
    Query("x_release_report", """
        SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(DISTINCT text) FROM documents) AS distinct_texts, (SELECT sum(quality) FROM labels) AS good, (SELECT count(*) FROM conversations) AS turns"""),
    Query("x_alternation", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) w WHERE role = prev"),
]
