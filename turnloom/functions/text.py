"""Scalars on text, dates and vectors, applied to whole tables."""

from turnloom.sql import Query

QUERIES = [
    Query("o318_compact_fragment", "SELECT doc_id, CASE WHEN length(t) > 160 THEN concat(substr(t, 1, 157), '...') ELSE t END AS fragment FROM (SELECT doc_id, trim({squeeze(text)}) AS t FROM documents) x"),
    Query("o320_sha256_text", "SELECT item_id, {sha256(text)} AS digest FROM benchmark"),
    Query("o321_normalised_question", "SELECT conv_id, turn, lower(trim({squeeze(text)})) AS question FROM conversations WHERE role = 'user'"),
    Query("o324_token_estimates", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.0) AS bigint)) END AS estimate, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, CAST(floor((length(text) + 2) / 3.0) AS bigint)) END AS guarded FROM documents"),
    Query("o326_head_and_tail", "SELECT page_id, CASE WHEN length(html) <= 600 THEN html ELSE concat(substr(html, 1, 400), ' ... ', substr(html, length(html) - 199, 200)) END AS trimmed FROM pages"),
    Query("o341_week_bounds", "SELECT o_orderkey, CAST({epoch(date_trunc('week', o_orderdate))} AS bigint) AS monday_s, CAST({epoch(date_trunc('month', o_orderdate))} AS bigint) AS month_s FROM orders"),
    Query("o345_cosine_to_first", """
        WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label)
        SELECT e.vec_id, e.label, round(CASE WHEN {dot(e.embedding;e.embedding)} = 0 OR {dot(p.embedding;p.embedding)} = 0 THEN 0 ELSE {dot(e.embedding;p.embedding)} / sqrt({dot(e.embedding;e.embedding)} * {dot(p.embedding;p.embedding)}) END, 6) AS cosine
        FROM embeddings e JOIN f ON e.label = f.label JOIN embeddings p ON p.vec_id = f.first_id"""),
    Query("o347_energy", "SELECT vec_id, round(sqrt({dot(embedding;embedding)} / {size(embedding)}), 6) AS rms FROM embeddings"),
    Query("o348_importance", """
        WITH m AS (SELECT user_id, event_id, {days(ts;TIMESTAMP '2024-02-01 00:00:00')} AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT event_id, round(0.15 * power(CAST(0.95 AS double), age) + 0.3 * least(ln(CAST(1 + n AS double)) / 5, 1), 6) AS importance FROM m"""),
    Query("o366_context_lines", "SELECT conv_id, turn, concat('[', CAST(conv_id AS varchar(20)), ':', CAST(turn AS varchar(20)), '] ', role, ': ', trim(text)) AS line FROM conversations"),
    Query("o407_leading_words", "SELECT doc_id, {joined({head({words(text)};120)}; )} AS summary FROM documents"),
    Query("o446_keywords", "SELECT item_id, tok, min(pos) AS pos FROM (SELECT item_id, tok, pos FROM benchmark {posexplode({words(text)})}) x WHERE length(tok) > 2 AND tok NOT IN ('the', 'and', 'for', 'with', 'that') GROUP BY item_id, tok"),
    Query("o449_events_to_dialogues", "SELECT event_id, CASE event_type WHEN 'error' THEN 'system' WHEN 'purchase' THEN 'assistant' ELSE 'user' END AS speaker, concat(event_type, ' ', CAST({json_int(props;k)} AS varchar(20))) AS content FROM events WHERE {json_int(props;k)} IS NOT NULL"),
]
