"""Retrieval over conversation turns and documents: lexical, BM25, vector and fused top-k.

Questions and turns meet on shared words, never as a full product; each question keeps
its top k through a ranking that Spark limits per group before the shuffle.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.nearest import exact_nearest
from turnloom.sql import Query, render

#: Words that carry no content.
STOP = "('the','a','an','and','of','to','in','is','it','that','this','was','for','on','with','as','by','at','be','are')"

TERMS = f"""
    terms AS (SELECT conv_id, turn, role, tok, count(*) AS tf FROM (SELECT conv_id, turn, role, tok FROM conversations {{explode({{words(text)}})}}) x WHERE tok NOT IN {STOP} GROUP BY conv_id, turn, role, tok),
    asked AS (SELECT DISTINCT item_id, tok FROM (SELECT item_id, tok FROM benchmark {{explode({{words(text)}})}}) y WHERE tok NOT IN {STOP})"""

QUERIES = [
    Query("x_flagship_lexical_topk", f"""
        WITH {TERMS},
        size_of AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id),
        hit AS (SELECT a.item_id, t.conv_id, t.turn, t.role, count(*) AS shared FROM asked a JOIN terms t ON a.tok = t.tok GROUP BY a.item_id, t.conv_id, t.turn, t.role),
        ranked AS (SELECT h.*, CAST(h.shared AS double) / s.n AS score, row_number() OVER (PARTITION BY h.item_id ORDER BY h.shared DESC, h.conv_id, h.turn) AS rnk FROM hit h JOIN size_of s ON h.item_id = s.item_id)
        SELECT item_id, conv_id, turn, role, shared, score, rnk FROM ranked WHERE rnk <= 10"""),
    Query("o221_bm25_topk", f"""
        WITH {TERMS},
        len AS (SELECT conv_id, turn, sum(tf) AS dl FROM terms GROUP BY conv_id, turn),
        stat AS (SELECT count(*) AS n, avg(CAST(dl AS double)) AS avgdl FROM len),
        df AS (SELECT tok, count(*) AS df FROM terms GROUP BY tok),
        hit AS (SELECT a.item_id, t.conv_id, t.turn,
                  sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avgdl))) AS score
                FROM asked a JOIN terms t ON a.tok = t.tok JOIN df d ON d.tok = t.tok JOIN len l ON l.conv_id = t.conv_id AND l.turn = t.turn CROSS JOIN stat s
                GROUP BY a.item_id, t.conv_id, t.turn),
        ranked AS (SELECT item_id, conv_id, turn, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, conv_id, turn) AS rnk FROM hit)
        SELECT item_id, conv_id, turn, score, rnk FROM ranked WHERE rnk <= 5"""),
    Query("o219_weighted_fusion", f"""
        WITH {TERMS},
        lexical AS (SELECT a.item_id, t.conv_id, CAST(count(DISTINCT t.tok) AS double) AS s FROM asked a JOIN terms t ON a.tok = t.tok WHERE t.role = 'user' GROUP BY a.item_id, t.conv_id),
        other AS (SELECT a.item_id, t.conv_id, CAST(count(DISTINCT t.tok) AS double) AS s FROM asked a JOIN terms t ON a.tok = t.tok WHERE t.role = 'assistant' GROUP BY a.item_id, t.conv_id),
        fused AS (SELECT coalesce(l.item_id, o.item_id) AS item_id, coalesce(l.conv_id, o.conv_id) AS conv_id, 0.75 * coalesce(l.s, 0) + 0.25 * coalesce(o.s, 0) AS weighted, greatest(coalesce(l.s, 0), coalesce(o.s, 0)) AS highest
                  FROM lexical l FULL OUTER JOIN other o ON l.item_id = o.item_id AND l.conv_id = o.conv_id)
        SELECT item_id, conv_id, CAST(weighted AS double) AS weighted, CAST(highest AS double) AS highest, rnk FROM (SELECT fused.*, row_number() OVER (PARTITION BY item_id ORDER BY weighted DESC, conv_id) AS rnk FROM fused) r WHERE rnk <= 5"""),
    Query("x_reciprocal_rank_fusion", f"""
        WITH {TERMS},
        hit AS (SELECT a.item_id, t.conv_id, count(DISTINCT t.tok) AS shared, sum(t.tf) AS mass FROM asked a JOIN terms t ON a.tok = t.tok GROUP BY a.item_id, t.conv_id),
        ranked AS (SELECT item_id, conv_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, conv_id) AS r1, row_number() OVER (PARTITION BY item_id ORDER BY mass DESC, conv_id) AS r2 FROM hit),
        scored AS (SELECT item_id, conv_id, r1, r2, CAST(1 AS double) / (60 + r1) + CAST(1 AS double) / (60 + r2) AS s FROM ranked)
        SELECT item_id, conv_id, r1, r2, rnk FROM (SELECT scored.*, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, conv_id) AS rnk FROM scored) z WHERE rnk <= 5"""),
    Query("o230_token_budget", """
        WITH cost AS (SELECT conv_id, turn, role, {size({words(text)})} AS cost FROM conversations),
        run AS (SELECT cost.*, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM cost)
        SELECT conv_id, turn, role, CAST(cost AS bigint) AS cost, CAST(used AS bigint) AS used FROM run WHERE used <= 120"""),
    Query("o207_context_window", f"""
        WITH anchor AS (SELECT conv_id, turn, CASE WHEN {{matches(lower(text);thing|tion)}} AND role = 'user' THEN 1 ELSE 0 END AS hit FROM conversations)
        SELECT conv_id, turn, hit FROM (SELECT anchor.*, max(hit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM anchor) w WHERE near = 1"""),
    Query("x_mmr_redundancy", """
        WITH s AS (SELECT conv_id, turn, {distinct({words(text)})} AS w FROM conversations),
        p AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, {common(a.w;b.w)} AS both_, {size(a.w)} AS na, {size(b.w)} AS nb FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.turn - a.turn <= 8)
        SELECT conv_id, turn_a, turn_b, CAST(both_ AS bigint) AS shared, CAST(na + nb - both_ AS bigint) AS together FROM p WHERE both_ * 4 >= na + nb - both_ AND both_ > 0"""),
]


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 5, "cosine_of_norms")
    return found.select("query_id", "vec_id", "score", "rnk")


#: The same search as one comparison of all pairs.
KNN = """
        WITH v AS (SELECT vec_id, embedding AS e, sqrt({dot(embedding;embedding)}) AS norm FROM embeddings),
        hit AS (SELECT q.vec_id AS query_id, v.vec_id, round({dot(q.e;v.e)} / (q.norm * v.norm), 6) AS score
                FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v ON q.vec_id <> v.vec_id)
        SELECT query_id, vec_id, score, rnk FROM (SELECT hit.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM hit) r WHERE rnk <= 5"""
BUILT = {"o218_knn_cosine": (knn_cosine, render(KNN, 1))}
