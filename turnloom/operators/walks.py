"""Walks over a graph of relations, from many starts at once, one join a hop.

``relations`` has relation_id (a text), subject, predicate and object; ``entities`` has
entity and entity_type; ``starts`` has entity. A relation is walked both ways. Ends that are no
entity are not walked to; a start that is none reaches what its relations name. Rows with
a null end are left out. Each hop's frontier is written once (see ``kept``), so a plan
holds one hop and a lost executor costs a reread; pairs of start and entity met before
are left out of later hops, so work is bounded by the pairs, not by the paths.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sql import kept

#: Paths that a task sorts, about; rows of a frontier that is broadcast at most.
SORTED, NARROW = 1 << 18, 1 << 18


def _steps(relations: DataFrame) -> DataFrame:
    """(node, other, ...) of every relation in both directions."""
    ahead = relations.withColumnsRenamed({"subject": "node", "object": "other"}).where("node is not null and other is not null")
    return ahead.union(ahead.where("node <> other").withColumns({"node": F.col("other"), "other": F.col("node")}))


def _onto(front: DataFrame, steps: DataFrame) -> DataFrame:
    """A frontier with the steps from it; only where it is wide are the steps shuffled."""
    narrow = front.limit(NARROW + 1).count() <= NARROW
    return steps.join(F.broadcast(front) if narrow else front, F.col("node") == F.col("entity"))


def _walk(starts: DataFrame, entities: DataFrame, hops: int, onward) -> list[DataFrame]:
    """The frontiers of each hop; ``onward(frontier, hop)`` gives (start, entity, ...), one row for a pair.

    Ends that are no entity are told from the pairs of a hop, not from all relations.
    """
    known = entities.select("entity")
    front = kept(starts.select(F.col("entity").alias("start"), "entity").where("entity is not null").distinct().withColumns({"hops": F.lit(0), "path": F.array().cast("array<string>")}))
    fronts = [front]
    for hop in range(1, hops + 1):
        met = reduce(DataFrame.union, (f.select("start", "entity") for f in fronts))
        front = kept(onward(front, hop).join(known, "entity", "left_semi").join(met, ["start", "entity"], "left_anti").withColumn("hops", F.lit(hop)).select("start", "entity", "hops", "path"))
        if front.isEmpty():
            break
        fronts.append(front)
    return fronts


def neighbours(relations: DataFrame, entities: DataFrame, starts: DataFrame, hops: int = 1, predicates=None) -> DataFrame:
    """(start, entity, hops): entities within ``hops`` of each start, with their distance, the start itself left out."""
    if predicates:
        relations = relations.where(F.col("predicate").isin(*predicates))
    steps = _steps(relations.select("subject", "object"))

    def onward(front, hop):
        return _onto(front, steps).select("start", F.col("other").alias("entity")).distinct().withColumn("path", F.array().cast("array<string>"))

    return reduce(DataFrame.union, _walk(starts, entities, hops, onward)).where("hops > 0").select("start", "entity", "hops")


def reasoned_paths(relations: DataFrame, entities: DataFrame, starts: DataFrame, target_type: str | None = None, predicates=(), hops: int = 3) -> DataFrame:
    """(start, entity, hops, path): entities of ``target_type`` (any, if None) that each start reaches, with the relations walked.

    The k-th relation has the k-th of ``predicates``; beyond them any will do. An entity is
    reached by the path that a breadth-first walk finds first when it takes relations in
    the order of their ids: of its shortest paths the least, id by id.
    """
    steps = _steps(relations.select("subject", "object", "predicate", "relation_id"))

    def onward(front, hop):
        fit = steps.where(F.col("predicate") == predicates[hop - 1]) if hop <= len(predicates) else steps
        longer = _onto(front, fit).select("start", F.col("other").alias("entity"), F.concat("path", F.array("relation_id")).alias("path"))
        # The least of texts is found by sorting: paths are dealt first, so that what a task sorts doesn't grow with the graph.
        return longer.repartition(-(-longer.count() // SORTED) or 1, "start", "entity").groupBy("start", "entity").agg(F.min("path").alias("path"))

    found = reduce(DataFrame.union, _walk(starts, entities, hops, onward)).where("hops > 0")
    if target_type is not None:
        found = found.join(entities.where(F.col("entity_type") == target_type).select("entity").distinct(), "entity", "left_semi")
    return found.select("start", "entity", "hops", "path")


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(relations, entities): regions contain nations, which are home of suppliers, which supply parts."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    links = [
        (table("nation"), "contains", named("region ", "n_regionkey"), named("nation ", "n_nationkey")),
        (table("supplier"), "home of", named("nation ", "s_nationkey"), named("supplier ", "s_suppkey")),
        (table("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplies", named("supplier ", "l_suppkey"), named("part ", "l_partkey")),
    ]
    relations = [df.select(F.concat_ws("|", F.lit(predicate), subject, object_).alias("relation_id"), subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object")) for df, predicate, subject, object_ in links]
    kinds = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")]
    entities = [table(t).select(named(f"{t} ", key).alias("entity"), F.lit(t).alias("entity_type")) for t, key in kinds]
    return reduce(DataFrame.union, relations), reduce(DataFrame.union, entities)


def near_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations, entities = trade_graph(spark, sf_dir)
    return neighbours(kept(relations.drop("relation_id")), entities, entities.where("entity_type = 'nation'"), 2)


def parts_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations, entities = trade_graph(spark, sf_dir)
    found = reasoned_paths(kept(relations), entities, entities.where("entity_type = 'region'"), "part", ("contains", "home of"), 3)
    return found.select("start", "entity", "hops", F.array_join("path", " > ").alias("path"))


_GRAPH = """rel AS (SELECT 'contains|region ' || n_regionkey || '|nation ' || n_nationkey AS id, 'contains' AS predicate, 'region ' || n_regionkey AS s, 'nation ' || n_nationkey AS o FROM nation
        UNION ALL SELECT 'home of|nation ' || s_nationkey || '|supplier ' || s_suppkey, 'home of', 'nation ' || s_nationkey, 'supplier ' || s_suppkey FROM supplier
        UNION ALL SELECT DISTINCT 'supplies|supplier ' || l_suppkey || '|part ' || l_partkey, 'supplies', 'supplier ' || l_suppkey, 'part ' || l_partkey FROM lineitem)"""
ORACLES = {
    "o132_two_hop_neighbours": f"""
        WITH {_GRAPH}, st AS (SELECT s AS a, o AS b FROM rel UNION SELECT o, s FROM rel), one AS (SELECT DISTINCT a AS start, b AS entity FROM st WHERE a LIKE 'nation %'),
        two AS (SELECT DISTINCT one.start, st.b AS entity FROM one JOIN st ON st.a = one.entity)
        SELECT start, entity, 1 AS hops FROM one UNION ALL SELECT start, entity, 2 FROM two WHERE entity <> start AND NOT EXISTS (SELECT 1 FROM one WHERE one.start = two.start AND one.entity = two.entity)""",
    "o134_paths_within_hops": f"""
        WITH {_GRAPH}, p AS (SELECT a.s AS start, c.o AS entity, a.id || ' > ' || b.id || ' > ' || c.id AS path, row_number() OVER (PARTITION BY a.s, c.o ORDER BY [a.id, b.id, c.id]) AS rnk
            FROM rel a JOIN rel b ON b.s = a.o AND b.predicate = 'home of' JOIN rel c ON c.s = b.o AND c.predicate = 'supplies' WHERE a.predicate = 'contains')
        SELECT start, entity, 3 AS hops, path FROM p WHERE rnk = 1""",
}
QUERIES = []
BUILT = {"o132_two_hop_neighbours": (near_nations, ORACLES["o132_two_hop_neighbours"]), "o134_paths_within_hops": (parts_of_regions, ORACLES["o134_paths_within_hops"])}
