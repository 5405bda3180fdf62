"""Context within a budget: tiers filled one after the other, lines taken or passed over.

The costs of texts are their words. Tiers are filled in order: in each, items are taken
until one does not fit, which ends the tier; what is left goes to the next tier. When
the bundle is written out, a line that does not fit is passed over and later ones may
still fit. Both depend on what was taken before, so they are folds over ordered rows: a
task holds one batch of rows and a few numbers per scope, however many items that has.

Defined cases: an item without words costs nothing and is taken while its tier is open.
Null texts count as empty. Items without a place take no part.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.streaming.folds import fold_table

#: Fixed value: the headings of a bundle's tiers.
HEADINGS = ("Session summaries:", "Timeline observations:", "Relevant memory entries:")


def words(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


class TieredBudget:
    """Items in the order of their tiers; each tier ends with the first item that doesn't fit."""

    output = "item long, tier int, cost long"

    def __init__(self, budget: int):
        self.budget = budget

    def start(self):
        return {"left": self.budget, "tier": None, "open": True}

    def step(self, state, row):
        if row["tier"] != state["tier"]:
            state["tier"], state["open"] = row["tier"], True
        if not state["open"] or (row["cost"] and row["cost"] > state["left"]):
            state["open"] = False
            return []
        state["left"] -= row["cost"]
        return [(row["item"], row["tier"], row["cost"])]

    def flush(self, state):
        return []


class SkippingBudget:
    """Items in order; one that doesn't fit is passed over."""

    output = "item long, cost long, used long"

    def __init__(self, budget: int):
        self.budget = budget

    def start(self):
        return {"used": 0}

    def step(self, state, row):
        if state["used"] + row["cost"] > self.budget:
            return []
        state["used"] += row["cost"]
        return [(row["item"], row["cost"], state["used"])]

    def flush(self, state):
        return []


def tiered(items: DataFrame, budget: int, scope: str = "scope") -> DataFrame:
    """scope, at, item, tier, cost of the items taken from (scope, tier, place, item, text)."""
    priced = items.where(F.col("place").isNotNull()).select(scope, "tier", "item", words(F.col("text")).cast("long").alias("cost"), (F.col("tier").cast("long") * (1 << 40) + F.col("place")).alias("at"))
    return fold_table(priced, scope, "at", TieredBudget(budget), tie="item")


def rendered(taken: DataFrame, budget: int, scope: str = "scope", headings=HEADINGS) -> DataFrame:
    """scope, bundle: the lines of the items taken (scope, at, item, tier, text) below their tiers' headings, within ``budget`` words."""
    heads = taken.groupBy(scope, "tier").agg(F.min("at").alias("at")).select(scope, (F.col("at") * 2 - 1).alias("at"), F.try_element_at(F.array(*map(F.lit, headings)), F.col("tier")).alias("line"))
    lines = taken.select(scope, (F.col("at") * 2).alias("at"), F.concat(F.lit("- "), F.coalesce("text", F.lit(""))).alias("line")).unionByName(heads)
    kept = fold_table(lines.select(scope, "at", F.col("at").alias("item"), words(F.col("line")).cast("long").alias("cost")), scope, "at", SkippingBudget(budget))
    shown = kept.select(scope, "at").join(lines, [scope, "at"])
    return shown.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("bundle"))


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the system says as summaries, the assistant as observations, the user as entries."""
    tier = F.when(F.col("role") == "system", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", tier.alias("tier"), F.col("turn").alias("place"), F.col("turn").alias("item"), "text")


def tiered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(conversation_items(spark, sf_dir), 200, "conv_id").select("conv_id", "item", "tier", "cost")


def rendered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = conversation_items(spark, sf_dir)
    taken = tiered(items, 200, "conv_id").drop("tier", "cost").join(items, ["conv_id", "item"])
    return rendered(taken, 150, "conv_id").select("conv_id", F.sha2("bundle", 256).alias("bundle_sha256"), words(F.col("bundle")).alias("words"))


def skipping_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest turns first; a user's turn costs 100, others 500, within 1200."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.length("text").alias("size"), F.when(F.col("role") == "user", 100).otherwise(500).cast("long").alias("cost"))
    ranked = rows.withColumn("rnk", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("size"), "turn")).cast("long")).withColumnRenamed("turn", "item")
    return fold_table(ranked, "conv_id", "rnk", SkippingBudget(1200)).withColumnRenamed("item", "turn")


QUERIES = []
BUILT = {
    "o229_budget_that_skips": (
        skipping_conversations,
        """
        WITH RECURSIVE item AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC NULLS LAST, turn) AS rnk, turn, CASE WHEN role = 'user' THEN 100 ELSE 500 END AS cost FROM conversations),
        walk(conv_id, rnk, turn, cost, used, taken) AS (
            SELECT conv_id, CAST(0 AS bigint), CAST(-1 AS bigint), 0, 0, false FROM item WHERE rnk = 1
            UNION ALL SELECT w.conv_id, CAST(i.rnk AS bigint), CAST(i.turn AS bigint), i.cost, CASE WHEN w.used + i.cost <= 1200 THEN w.used + i.cost ELSE w.used END, w.used + i.cost <= 1200 FROM walk w JOIN item i ON i.conv_id = w.conv_id AND i.rnk = w.rnk + 1)
        SELECT conv_id, turn, rnk, CAST(cost AS bigint) AS cost, CAST(used AS bigint) AS used FROM walk WHERE taken""",
    ),
    "o231_tiered_budget": (
        tiered_conversations,
        r"""
        WITH i AS (SELECT conv_id, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS tier, turn AS item, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda t: t <> '')) AS cost FROM conversations),
        r AS (SELECT i.*, sum(cost) OVER (PARTITION BY conv_id, tier ORDER BY item) AS run FROM i),
        a AS (SELECT * FROM r WHERE tier = 1 AND run <= 200), u AS (SELECT conv_id, sum(cost) AS used FROM a GROUP BY conv_id),
        b AS (SELECT r.*, coalesce(u.used, 0) AS before_ FROM r LEFT JOIN u USING (conv_id) WHERE tier = 2 AND run <= 200 - coalesce(u.used, 0)),
        v AS (SELECT conv_id, sum(cost) AS used FROM (SELECT conv_id, cost FROM a UNION ALL SELECT conv_id, cost FROM b) x GROUP BY conv_id),
        c AS (SELECT r.* FROM r LEFT JOIN v USING (conv_id) WHERE tier = 3 AND run <= 200 - coalesce(v.used, 0))
        SELECT conv_id, item, CAST(tier AS int) AS tier, CAST(cost AS bigint) AS cost FROM (SELECT conv_id, item, tier, cost FROM a UNION ALL SELECT conv_id, item, tier, cost FROM b UNION ALL SELECT conv_id, item, tier, cost FROM c) z""",
    ),
    "o232_rendered_bundles": (rendered_conversations, None),
}
