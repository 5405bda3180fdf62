"""Release gates and summaries: contracts on tables, coverage, gate tables with what blocks, metric roll-ups."""

from turnloom.sql import Query

GATE = """
    gate AS (
        SELECT 'text_present' AS gate, true AS blocking, count(*) AS checked, sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS failed FROM documents
        UNION ALL SELECT 'length_recorded' AS gate, true AS blocking, count(*) AS checked, sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS failed FROM documents
        UNION ALL SELECT 'label_in_range' AS gate, true AS blocking, count(*) AS checked, sum(CASE WHEN quality IN (0, 1) AND toxic IN (0, 1) THEN 0 ELSE 1 END) AS failed FROM labels
        UNION ALL SELECT 'label_has_document' AS gate, true AS blocking, count(*) AS checked, sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END) AS failed FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
        UNION ALL SELECT 'turn_long_enough' AS gate, false AS blocking, count(*) AS checked, sum(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END) AS failed FROM conversations)"""

QUERIES = [
    Query("o415_turn_contract", """
        SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' WHEN copies > 1 THEN 'repeated' WHEN text IS NULL OR trim(text) = '' THEN 'empty' ELSE 'ok' END AS state
        FROM (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, turn) AS copies FROM conversations) c"""),
    Query("o416_provenance_contract", "SELECT page_id, {sha256(html)} AS digest, url IS NOT NULL AND url <> '' AS has_origin, {matches(url;^https?://)} AS well_formed FROM pages"),
    Query("o418_prediction_coverage", """
        SELECT d.source, count(*) AS asked, count(l.doc_id) AS answered, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"""),
    Query("o420_gates", f"WITH {GATE} SELECT gate, blocking, checked, CAST(failed AS bigint) AS failed, CASE WHEN failed = 0 THEN 'pass' WHEN blocking THEN 'block' ELSE 'warn' END AS status FROM gate"),
    Query("o421_source_ratios", "SELECT d.source, count(*) AS n, round(CAST(sum(l.toxic) AS double) / count(*), 6) AS toxic_share, round(CAST(sum(l.quality) AS double) / count(*), 6) AS good_share FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"),
    Query("o422_question_contract", """
        SELECT q.conv_id, q.turn, CASE WHEN a.conv_id IS NULL THEN 'unanswered' WHEN a.role <> 'assistant' THEN 'answered by another' ELSE 'ok' END AS state
        FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'"""),
    Query("o427_prediction_histogram", "SELECT role, count(*) AS n, CAST(sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS bigint) AS non_empty, CAST(sum(CASE WHEN contains(lower(text), 'error') THEN 1 ELSE 0 END) AS bigint) AS errors FROM conversations GROUP BY role"),
    Query("o429_requirement_status", f"""
        WITH {GATE}, need AS (SELECT 'text' AS requirement, 'text_present' AS gate UNION ALL SELECT 'text', 'length_recorded' UNION ALL SELECT 'labels', 'label_in_range' UNION ALL SELECT 'labels', 'label_has_document' UNION ALL SELECT 'pages', 'page_parsed')
        SELECT n.requirement, CASE WHEN count(*) > count(g.gate) THEN 'missing' WHEN sum(g.failed) > 0 THEN 'blocked' ELSE 'passed' END AS status FROM need n LEFT JOIN gate g ON g.gate = n.gate GROUP BY n.requirement"""),
    Query("o430_failed_actions", f"WITH {GATE} SELECT gate, concat('repair ', CAST(failed AS varchar(20)), ' of ', CAST(checked AS varchar(20)), ' rows') AS action FROM gate WHERE blocking AND failed > 0"),
    Query("o151_token_sums", "SELECT event_type, CAST(sum({json_int(props;k)}) AS bigint) AS total, count(*) AS n FROM events GROUP BY event_type"),
    Query("o152_mean_metric", "SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events"),
    Query("o153_grouped_metric", "SELECT label, count(*) AS n, round(avg(sqrt({dot(embedding;embedding)})), 6) AS mean_norm FROM embeddings GROUP BY label"),
    Query("o155_source_summary", "SELECT source, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(CAST(n_chars AS double)), 6) AS mean, CAST(sum(n_chars) AS bigint) AS total FROM documents GROUP BY source"),
    Query("o157_sample_summary", """
        WITH c AS (SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked FROM conversations GROUP BY conv_id)
        SELECT turns, count(*) AS conversations_, CAST(sum(asked) AS bigint) AS asked FROM c GROUP BY turns"""),
    Query("o159_role_ratios", "SELECT conv_id, round(CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS double) / count(*), 6) AS user_share, round(CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS double) / count(*), 6) AS system_share FROM conversations GROUP BY conv_id"),
    Query("o161_interpolated_percentile", "SELECT event_type, round({quantile(value;0.5)}, 6) AS p50, round({quantile(value;0.95)}, 6) AS p95 FROM events GROUP BY event_type"),
    Query("o163_token_stats", """
        WITH t AS (SELECT conv_id, CAST(sum({size({words(text)})}) AS bigint) AS whole_, CAST(sum(CASE WHEN role = 'user' THEN {size({words(text)})} ELSE 0 END) AS bigint) AS part_ FROM conversations GROUP BY conv_id)
        SELECT CAST(sum(part_) AS bigint) AS total, round(avg(CAST(part_ AS double)), 6) AS mean, round({quantile(part_;0.95)}, 6) AS p95, max(part_) AS most, round(1 - CAST(sum(part_) AS double) / sum(whole_), 6) AS saved FROM t"""),
    Query("o165_latency_summary", """
        WITH g AS (SELECT user_id, {epoch(ts)} - lag({epoch(ts)}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
        SELECT user_id, count(gap) AS n, round(avg(CAST(gap AS double)), 4) AS mean, CAST(sum(gap) AS bigint) AS total, max(gap) AS most FROM g GROUP BY user_id"""),
    Query("o166_dataset_count", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source"),
    Query("o167_score_shares", "SELECT event_type, round(avg(value), 6) AS mean, round(avg(CASE WHEN value >= 80 THEN CAST(1 AS double) ELSE CAST(0 AS double) END), 6) AS good_share, round(avg(CASE WHEN value >= 50 THEN CAST(1 AS double) ELSE CAST(0 AS double) END), 6) AS fair_share FROM events GROUP BY event_type"),
    Query("o171_group_counters", "SELECT l_linestatus, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bigint) AS returned FROM lineitem GROUP BY l_linestatus"),
]
