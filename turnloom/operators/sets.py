"""Set operations: unions by priority or order, shards put together, coverage and partition checks, comparisons of two sides."""

from turnloom.sql import Query

QUERIES = [
    Query("o251_priority_union", """
        WITH u AS (SELECT doc_id, 1 AS pri FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 AS pri FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 3 AS pri FROM documents WHERE lang = 'en')
        SELECT doc_id, min(pri) AS pri, count(*) AS found FROM u GROUP BY doc_id"""),
    Query("o252_first_occurrence", "SELECT conv_id, turn, said FROM (SELECT conv_id, turn, lower(trim(text)) AS said, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) AS rnk FROM conversations) w WHERE rnk = 1"),
    Query("o254_ordered_union", """
        SELECT doc_id, CAST(n_chars AS double) AS score, 'first' AS origin FROM documents WHERE lang = 'en'
        UNION ALL SELECT d.doc_id, CAST(d.n_chars AS double) / 100 AS score, 'added' AS origin FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.lang <> 'en'"""),
    Query("o257_shard_union", """
        WITH u AS (SELECT 'customer' AS shard, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier' AS shard, s_suppkey AS id, s_nationkey AS nation FROM supplier)
        SELECT nation, count(*) AS n, count(DISTINCT id) AS ids, count(*) - count(DISTINCT concat(shard, '-', CAST(id AS varchar(20)))) AS repeats FROM u GROUP BY nation"""),
    Query("o261_partition_errors", """
        SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) x
        UNION ALL SELECT 'extra' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents) y"""),
    Query("o262_one_split", "SELECT conv_id, count(DISTINCT role) AS roles, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS whole FROM conversations GROUP BY conv_id"),
    Query("o263_coverage_quota", """
        SELECT d.source, count(*) AS n, count(l.doc_id) AS covered, CAST(floor((count(*) + 9) / 10.0) AS bigint) AS quota, count(l.doc_id) * 10 >= count(*) AS met
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"""),
    Query("o103_recent_of_open", """
        SELECT o_custkey, o_orderkey, c_mktsegment FROM (SELECT o.o_custkey, o.o_orderkey, c.c_mktsegment, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rnk
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'O') w WHERE rnk <= 10"""),
    Query("o112_hash_coverage", """
        WITH a AS (SELECT doc_id, {sha256(text)} AS digest FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {sha256(text)} AS digest FROM benchmark)
        SELECT b.item_id, count(a.doc_id) AS copies FROM b LEFT JOIN a ON a.digest = b.digest GROUP BY b.item_id"""),
    Query("o119_compare_runs", """
        SELECT d.lang, sum(CASE WHEN l.quality > l.toxic THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN l.quality < l.toxic THEN 1 ELSE 0 END) AS regressions, sum(CASE WHEN l.quality = l.toxic THEN 1 ELSE 0 END) AS ties
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang"""),
    Query("o122_sources_of_parts", """
        SELECT DISTINCT s.s_suppkey, s.s_nationkey, p.p_brand FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size >= 40"""),
    Query("o131_relations_both_ways", """
        WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem)
        SELECT node, sum(out_) AS outgoing, sum(in_) AS incoming FROM (SELECT s AS node, 1 AS out_, 0 AS in_ FROM e UNION ALL SELECT o AS node, 0 AS out_, 1 AS in_ FROM e) x GROUP BY node"""),
    Query("o133_induced_subgraph", """
        WITH keep_s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10), keep_p AS (SELECT p_partkey FROM part WHERE p_size < 25)
        SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM keep_s) AND l_partkey IN (SELECT p_partkey FROM keep_p) GROUP BY l_suppkey, l_partkey"""),
]
