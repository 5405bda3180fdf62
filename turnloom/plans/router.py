"""Routing a question between two result lists by the shape of their scores.

Score lists are arrays of doubles, best first; a null or empty list has features of 0.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Concentration, best score and lead that make the semantic list easy; margins of the episodic one.
GINI, TOP1, GAP, EPISODIC, CLOSE = 0.65, 0.75, 0.15, 0.1, 0.05


def _listed(scores: Column) -> Column:
    return F.coalesce(scores, F.array().cast("array<double>"))


def total(scores: Column) -> Column:
    return F.aggregate(_listed(scores), F.lit(0.0), lambda a, x: a + x)


def gini(scores: Column) -> Column:
    """How much of the sum few scores hold: 0 for one score, none, or a sum of 0."""
    ordered = F.array_sort(_listed(scores))
    n, whole = F.size(ordered), total(scores)
    weighted = F.aggregate(F.transform(ordered, lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, x: a + x)
    return F.when((n > 1) & (whole != 0), 2.0 * weighted / (n * whole) - (n + 1.0) / n).otherwise(0.0)


def entropy(scores: Column) -> Column:
    """Bits of the scores taken as shares of their sum; scores of 0 or less count in the sum alone."""
    whole = total(scores)
    bits = F.aggregate(F.filter(_listed(scores), lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / whole * F.log2(x / whole))
    return F.when(whole != 0, bits).otherwise(0.0)


def features(semantic: Column, episodic: Column) -> Column:
    """struct of gini, entropy, top1, gap and mean of both lists."""
    out = []
    for name, scores in (("sem", semantic), ("epi", episodic)):
        first, second = (F.get(_listed(scores), F.lit(i)) for i in (0, 1))
        n = F.size(_listed(scores))
        values = {"gini": gini(scores), "entropy": entropy(scores), "top1": F.coalesce(first, F.lit(0.0)), "gap": F.coalesce(first - second, F.lit(0.0)), "mean": F.when(n > 0, total(scores) / n).otherwise(0.0)}
        out += [v.alias(f"{k}_{name}") for k, v in values.items()]
    return F.struct(*out)


def route(shape: Column, safe: Column, trained: Column | None = None, episodic: float = EPISODIC, close: float = CLOSE) -> Column:
    """struct(decision, confidence): the episodic list alone where the question must be ``safe``, else what ``trained`` decides (a struct of the same fields, where not null), else by thresholds."""
    choice = lambda name, sure: F.struct(F.lit(name).alias("decision"), F.lit(sure).alias("confidence"))
    easy = (shape["gini_sem"] >= GINI) & (shape["top1_sem"] >= TOP1) & (shape["gap_sem"] >= GAP)
    rules = (
        F.when(shape["top1_epi"] >= shape["top1_sem"] + episodic, choice("BASELINE_EPISODIC", 0.8))
        .when(~easy, choice("BASELINE_EPISODIC", 0.6))
        .when(shape["top1_epi"] >= shape["top1_sem"] - close, choice("HYBRID", 0.7))
        .otherwise(choice("SEMANTIC_ONLY", 0.75))
    )
    learned = rules if trained is None else F.coalesce(trained, rules)
    return F.when(F.coalesce(safe, F.lit(False)), choice("BASELINE_EPISODIC", 1.0)).otherwise(learned)


def user_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the shares that kinds of events have in their count (semantic) and in their value, sharpened (episodic)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    best = events.groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list("n"))).alias("ns"), F.reverse(F.array_sort(F.collect_list("v"))).alias("vs"))
    # Powers of ranks spread the lists of different users over all outcomes.
    sharp = lambda column: F.transform(column, lambda x, i: F.round(x / F.get(column, F.lit(0)) / F.pow(F.lit(4.0), (F.col("user_id") % 4) * i) * (1 - 0.1 * (F.col("user_id") % 3)), 6))
    return best.select("user_id", sharp(F.col("ns").cast("array<double>")).alias("semantic"), F.transform(F.col("vs"), lambda x, i: F.round(x / F.get("vs", F.lit(0)) * (F.col("user_id") % 5) / 4, 6)).alias("episodic"))


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = user_lists(spark, sf_dir).select("user_id", features(F.col("semantic"), F.col("episodic")).alias("f"))
    names = [f"{k}_{s}" for s in ("sem", "epi") for k in ("gini", "entropy", "top1", "gap", "mean")]
    return f.select("user_id", *(F.round(f"f.{n}", 6).alias(n) for n in names))


def user_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = user_lists(spark, sf_dir).select("user_id", route(features(F.col("semantic"), F.col("episodic")), F.col("user_id") % 7 == 0).alias("r"))
    return r.select("user_id", "r.decision", "r.confidence")


def heuristic_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = user_lists(spark, sf_dir).select("user_id", route(features(F.col("semantic"), F.col("episodic")), F.lit(False)).alias("r"))
    return r.select("user_id", "r.decision", "r.confidence")


_ITEMS = """l AS (SELECT user_id, 'sem' AS k, count(*)::double AS x FROM events GROUP BY user_id, event_type UNION ALL SELECT user_id, 'epi', CAST(sum(CAST(value AS decimal(18,2))) AS double) FROM events GROUP BY user_id, event_type),
    r AS (SELECT user_id, k, x / max(x) OVER (PARTITION BY user_id, k) AS x, row_number() OVER (PARTITION BY user_id, k ORDER BY x DESC) - 1 AS i FROM l),
    v AS (SELECT user_id, k, i, CASE k WHEN 'sem' THEN round(x / pow(4e0, user_id % 4 * i) * (1 - 0.1e0 * (user_id % 3)), 6) ELSE round(x * (user_id % 5) / 4, 6) END AS x FROM r),
    a AS (SELECT *, sum(x) OVER (PARTITION BY user_id, k) AS s, count(*) OVER (PARTITION BY user_id, k) AS n, row_number() OVER (PARTITION BY user_id, k ORDER BY x, i DESC) AS place FROM v),
    f AS (SELECT user_id, k, CASE WHEN max(n) > 1 AND max(s) <> 0 THEN 2e0 * sum(place * x) / (max(n) * max(s)) - (max(n) + 1e0) / max(n) ELSE 0 END AS gini, CASE WHEN max(s) <> 0 THEN -sum(CASE WHEN x > 0 THEN x / s * log2(x / s) ELSE 0 END) ELSE 0 END AS entropy,
        max(CASE WHEN i = 0 THEN x END) AS top1, coalesce(max(CASE WHEN i = 0 THEN x END) - max(CASE WHEN i = 1 THEN x END), 0) AS gap, max(s) / max(n) AS mean FROM a GROUP BY user_id, k),
    w AS (SELECT user_id, """ + ", ".join(f"max(CASE WHEN k = '{s}' THEN {m} END) AS {m}_{s}" for s in ("sem", "epi") for m in ("gini", "entropy", "top1", "gap", "mean")) + " FROM f GROUP BY user_id)"
_RULE = "CASE WHEN {} THEN 'e 1.0' WHEN top1_epi >= top1_sem + 0.1 THEN 'e 0.8' WHEN NOT (gini_sem >= 0.65 AND top1_sem >= 0.75 AND gap_sem >= 0.15) THEN 'e 0.6' WHEN top1_epi >= top1_sem - 0.05 THEN 'h 0.7' ELSE 's 0.75' END"
_ROUTED = "SELECT user_id, CASE d[1] WHEN 'e' THEN 'BASELINE_EPISODIC' WHEN 'h' THEN 'HYBRID' ELSE 'SEMANTIC_ONLY' END AS decision, CAST(d[3:] AS double) AS confidence FROM (SELECT user_id, {} AS d FROM w) x"
QUERIES = []
BUILT = {
    "o198_route_features": (user_features, f"WITH {_ITEMS} SELECT user_id, " + ", ".join(f"round({m}_{s}, 6) AS {m}_{s}" for s in ("sem", "epi") for m in ("gini", "entropy", "top1", "gap", "mean")) + " FROM w"),
    "o461_heuristic_routes": (heuristic_routes, f"WITH {_ITEMS} {_ROUTED.format(_RULE.format('false'))}"),
    "o462_routes": (user_routes, f"WITH {_ITEMS} {_ROUTED.format(_RULE.format('user_id % 7 = 0'))}"),
}
