"""Graph operators over edges that the tables imply: neighbourhoods, degrees, paths, entity resolution."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sql import Query, kept, render

#: Pairs that one task counts, about.
PAIRS = 1 << 22

EDGES = "e AS (SELECT DISTINCT l.l_suppkey AS s, l.l_partkey AS p FROM lineitem l)"

QUERIES = [
    Query("x_degrees", f"WITH {EDGES} SELECT s AS node, count(*) AS degree, min(p) AS first_neighbour FROM e GROUP BY s"),
    # A turn's ancestors reach turn 0 where no turn before it is missing: then it is as deep as its number.
    Query("o137_ancestors", "SELECT conv_id, turn, CAST(0 AS bigint) AS root, CAST(turn AS int) AS depth FROM (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE turn >= 0) c WHERE nth = turn"),
    Query("x_entity_resolution", """
        WITH e AS (SELECT tok, conv_id FROM (SELECT DISTINCT conv_id, tok FROM conversations {explode({words(text)})}) x WHERE length(tok) >= 8)
        SELECT substr(tok, 1, 6) AS canonical, count(DISTINCT tok) AS aliases, count(*) AS mentions, min(tok) AS name FROM e GROUP BY substr(tok, 1, 6) HAVING count(DISTINCT tok) > 1"""),
    Query("x_co_occurrence", """
        WITH r AS (SELECT DISTINCT user_id, event_type FROM events)
        SELECT a.event_type AS a, b.event_type AS b, count(*) AS users_ FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY a.event_type, b.event_type"""),
]


def common_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers with two or more parts in common. A supplier's pairs meet in one of as many tasks as the number of pairs asks for."""
    edges = kept(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).where("s IS NOT NULL AND p IS NOT NULL").distinct())
    pairs = edges.groupBy("p").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(pairs) // PAIRS))
    sellers = edges.groupBy("p").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    ahead = sellers.select("ss", F.posexplode("ss").alias("i", "a")).select("a", F.expr("slice(ss, i + 2, size(ss))").alias("bs")).where("size(bs) > 0")
    return ahead.repartition(tasks, "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


#: The same pairs as a join of the edges with themselves.
COMMON = f"""
        WITH {EDGES}
        SELECT a.s AS a, b.s AS b, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s HAVING count(*) >= 2"""
BUILT = {"x_common_neighbours": (common_neighbours, render(COMMON, 1))}
