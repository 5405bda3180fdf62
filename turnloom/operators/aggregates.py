"""Aggregates: counts, ratios, distinct counts, partial and final sums, samples, set operations."""

from turnloom.sql import Query

QUERIES = [
    Query("o146_role_stats", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations_, sum(length(text)) AS chars, max(turn) AS last_turn FROM conversations GROUP BY role"),
    Query("o158_unique_ratio", "SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_texts, CAST(count(DISTINCT text) AS double) / count(*) AS ratio FROM documents GROUP BY source"),
    Query("o258_partial_final_merge", """
        WITH shard AS (SELECT doc_id % 8 AS shard, lang, count(*) AS n, sum(n_chars) AS chars, max(n_chars) AS longest FROM documents GROUP BY doc_id % 8, lang)
        SELECT lang, CAST(sum(n) AS bigint) AS n, CAST(sum(chars) AS bigint) AS chars, max(longest) AS longest, count(*) AS shards FROM shard GROUP BY lang"""),
    Query("x_histogram", "SELECT CAST(floor(n_chars / 500.0) AS bigint) AS bucket, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY CAST(floor(n_chars / 500.0) AS bigint)"),
    Query("x_conditional_counts", "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS high, sum(CASE WHEN {json_int(props;k)} % 2 = 0 THEN 1 ELSE 0 END) AS even_k, max({json_int(props;k)}) AS max_k FROM events GROUP BY event_type"),
    Query("x_collect_timeline", "SELECT conv_id, {joined({collect(role;turn)};>)} AS path, count(*) AS n FROM conversations GROUP BY conv_id"),
    Query("x_top_source_by_lang", "SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rnk FROM documents GROUP BY lang, source) w WHERE rnk = 1"),
    Query("x_stratified_sample", """
        SELECT d.doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS varchar(20))), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents) d WHERE pos <= CAST(ceil(n * 0.1) AS bigint)"""),
    Query("x_ordered_union", "SELECT doc_id AS id, 'document' AS kind, length(text) AS n FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark"),
    Query("x_coverage_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
    Query("x_intersect", "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 1"),
    Query("x_union_distinct", "SELECT text FROM benchmark UNION SELECT text FROM conversations WHERE role = 'system'"),
    Query("x_token_counts", "SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, tok FROM documents {explode({words(text)})}) x GROUP BY tok HAVING count(*) >= 5"),
    Query("x_q1_rollup", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS double) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
]
