"""Scoped searches and what is built from their hits: filters before ranking, fused scores, distinct labels, edges, support."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.nearest import exact_nearest
from turnloom.operators.turns import numbered
from turnloom.sql import Query, render

NORM = """
    unit AS (SELECT vec_id, label, embedding, {dot(embedding;embedding)} AS sq FROM embeddings),
    anchor AS (SELECT vec_id AS anchor_id, embedding, sq FROM unit WHERE vec_id % 20 = 0),
    near AS (SELECT a.anchor_id, u.vec_id, u.label, round(sqrt(greatest(a.sq + u.sq - 2 * {dot(a.embedding;u.embedding)}, 0)), 6) AS dist, round({dot(a.embedding;u.embedding)} / sqrt(a.sq * u.sq), 6) AS cosine
             FROM unit u JOIN anchor a ON u.vec_id <> a.anchor_id WHERE a.sq > 0 AND u.sq > 0)"""

QUERIES = [
    Query("o072_structured_search", "SELECT source, doc_id, rnk FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rnk FROM documents WHERE lang = 'en' AND contains(lower(text), 'the')) w WHERE rnk <= 5"),
    Query("o073_scoped_filter", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase') AND value >= 50 AND props IS NOT NULL"),
    Query("o075_entries_of_session", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')"),
    Query("o078_rows_of_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    Query("o107_three_way_summary", """
        SELECT n.n_name, count(*) AS n, count(DISTINCT o.o_custkey) AS customers, round(CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS double) / count(*), 6) AS finished
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name"""),
    Query("o120_fact_support", """
        WITH cited AS (SELECT DISTINCT conv_id, turn, tok FROM conversations {explode({words(text)})} WHERE length(tok) >= 6), fact AS (SELECT DISTINCT tok FROM benchmark {explode({words(text)})})
        SELECT c.conv_id, c.turn, count(*) AS cited, count(f.tok) AS supported FROM cited c LEFT JOIN fact f ON f.tok = c.tok GROUP BY c.conv_id, c.turn"""),
    Query("o121_row_index", f"WITH {numbered('documents', 'source', 'doc_id', 'doc_id, source')} SELECT source, doc_id, num AS line FROM numbered"),
    Query("o124_edge_type", """
        WITH e AS (SELECT user_id, event_id, event_type, {epoch(ts)} AS s, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type, lead({epoch(ts)}) OVER w AS next_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, next_id, CASE WHEN event_type = 'error' OR next_type = 'error' THEN 'conflict_with' WHEN next_s - s <= 600 THEN 'temporal_near' WHEN event_type = next_type THEN 'same_entity' ELSE 'same_session' END AS edge_type FROM e WHERE next_id IS NOT NULL"""),
    Query("o136_units_of_entity", """
        WITH m AS (SELECT DISTINCT item_id, tok FROM benchmark {explode({words(text)})} WHERE length(tok) >= 8)
        SELECT tok AS entity, count(*) AS units, {joined({collect(CAST(item_id AS varchar(20));item_id)};|)} AS linked FROM m GROUP BY tok"""),
    Query("o145_shard_metrics", """
        WITH u AS (SELECT 'quality' AS metric, quality AS hit FROM labels UNION ALL SELECT 'toxic' AS metric, toxic AS hit FROM labels)
        SELECT metric, count(*) AS n, round(avg(CAST(hit AS double)), 6) AS mean FROM u GROUP BY metric"""),
    Query("o148_conditional_means", "SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS bought, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS sound, count(*) AS n FROM events GROUP BY user_id"),
    Query("o149_overall_and_groups", "SELECT lang, source, grouping(lang) AS all_langs, grouping(source) AS all_sources, count(*) AS n, CAST(sum(n_chars) AS bigint) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source))"),
    Query("o206_top_then_in_order", """
        WITH r AS (SELECT conv_id, turn, length(text) AS weight, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rnk FROM conversations)
        SELECT conv_id, turn, weight, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r WHERE rnk <= 3"""),
    Query("o211_distinct_labels", "SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rnk FROM documents) w WHERE rnk = 1"),
    Query("o220_max_fusion", """
        WITH a AS (SELECT user_id, max(value) AS best FROM events WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, max(value) AS best FROM events WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(coalesce(a.best, 0), coalesce(b.best, 0)) AS score FROM a FULL OUTER JOIN b ON a.user_id = b.user_id"""),
    Query("o260_merged_results", """
        WITH u AS (SELECT lang AS kind, n_chars AS v FROM documents UNION ALL SELECT role AS kind, length(text) AS v FROM conversations UNION ALL SELECT 'page' AS kind, length(html) AS v FROM pages)
        SELECT kind, count(*) AS n, CAST(sum(v) AS bigint) AS total, min(v) AS lo, max(v) AS hi FROM u GROUP BY kind"""),
    Query("o338_fallback_from_first", """
        WITH y AS (SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '(19|20)[0-9][0-9]', 0), '') AS int) AS y FROM conversations), f AS (SELECT conv_id, min(turn) AS at FROM y WHERE y IS NOT NULL GROUP BY conv_id)
        SELECT y.conv_id, y.turn, coalesce(y.y, b.y) AS year_ FROM y LEFT JOIN f ON f.conv_id = y.conv_id LEFT JOIN y b ON b.conv_id = f.conv_id AND b.turn = f.at"""),
    Query("o363_payload_or_empty", "SELECT event_id, coalesce({json_int(props;k)}, -1) AS k FROM events"),
    Query("o426_traceable_fixes", """
        SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'untraceable' WHEN l.quality NOT IN (0, 1) OR l.toxic NOT IN (0, 1) THEN 'malformed' ELSE 'ok' END AS state FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id"""),
]


def l2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 5, "l2", nulls=False)
    return found.select(F.col("query_id").alias("anchor_id"), "vec_id", F.col("score").alias("dist"), "rnk")


def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 10, "cosine", nulls=False)
    return found.where("score >= 0.1").select(F.col("query_id").alias("anchor_id"), "vec_id", F.col("score").alias("cosine"))


#: The same searches as one comparison of all pairs.
L2 = f"WITH {NORM} SELECT anchor_id, vec_id, dist, rnk FROM (SELECT anchor_id, vec_id, dist, row_number() OVER (PARTITION BY anchor_id ORDER BY dist, vec_id) AS rnk FROM near) w WHERE rnk <= 5"
THRESHOLD = f"WITH {NORM} SELECT anchor_id, vec_id, cosine FROM (SELECT anchor_id, vec_id, cosine, row_number() OVER (PARTITION BY anchor_id ORDER BY cosine DESC, vec_id) AS rnk FROM near) w WHERE rnk <= 10 AND cosine >= 0.1"
BUILT = {"o214_l2_neighbours": (l2_neighbours, render(L2, 1)), "o217_cosine_threshold": (cosine_threshold, render(THRESHOLD, 1))}
