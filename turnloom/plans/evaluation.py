"""Scores of predicted against reference answers, retrieval metrics and grouped roll-ups."""

from turnloom.sql import Query

PAIRED = """
    pair AS (SELECT u.conv_id, u.turn, {words(u.text)} AS gold, {words(a.text)} AS said, u.text AS gold_text, a.text AS said_text
             FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""

QUERIES = [
    Query("x_exact_match", f"""
        WITH {PAIRED}
        SELECT conv_id, turn, {{joined(gold; )}} = {{joined(said; )}} AS same, abs(length(gold_text) - length(said_text)) AS length_gap FROM pair"""),
    Query("o147_grouping_sets", """
        WITH m AS (SELECT lang, source, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
        SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(quality) AS good, sum(n_chars) AS chars FROM m GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))"""),
    Query("x_recall_at_k", """
        WITH s AS (SELECT b.item_id, d.doc_id, count(*) AS shared FROM (SELECT DISTINCT item_id, tok FROM benchmark {explode({words(text)})}) b JOIN (SELECT DISTINCT doc_id, tok FROM documents {explode({words(text)})}) d ON b.tok = d.tok AND length(b.tok) >= 9 GROUP BY b.item_id, d.doc_id),
        r AS (SELECT s.*, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rnk FROM s),
        j AS (SELECT r.item_id, r.rnk, coalesce(l.quality, 0) AS rel FROM r LEFT JOIN labels l ON r.doc_id = l.doc_id WHERE rnk <= 10)
        SELECT item_id, sum(CASE WHEN rnk <= 5 THEN rel ELSE 0 END) AS hits_at_5, sum(rel) AS hits_at_10, CAST(1 AS double) / min(CASE WHEN rel = 1 THEN rnk END) AS mrr FROM j GROUP BY item_id"""),
    Query("x_latency_percentiles", """
        SELECT event_type, count(*) AS n, round({quantile(value;0.5)}, 4) AS p50, round({quantile(value;0.95)}, 4) AS p95, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type"""),
    Query("x_macro_micro", """
        WITH g AS (SELECT lang, count(*) AS n, sum(quality) AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang)
        SELECT CAST(sum(ok) AS bigint) AS ok, CAST(sum(n) AS bigint) AS n, CAST(sum(ok) AS double) / sum(n) AS micro, round(avg(CAST(ok AS double) / n), 9) AS macro FROM g"""),
]
