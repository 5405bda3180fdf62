"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

A digest that many rows share would land in one shuffle task. A Misra-Gries
summary of the digests, kept in bounded sketches that merge in two levels, names
the candidates; an exact count verifies them; the rows they remove are dropped
map-side against the broadcast winners. All other rows meet in an ordinary shuffle.

Defined cases: null text counts as empty. Rows repeated with the same id and text
form a group in which one row stays. A null id loses to any other id. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import picked, stash, unused

#: Counters of a sketch, and the most candidates taken from it: the broadcast is bounded by these.
SKETCH_ITEMS, HEAVY_DIGESTS = 4096, 1024
#: Sketches of the first level; each gathers the sketches of many scan tasks.
SKETCH_GROUPS = 64


def frequent_digests(digests: DataFrame, column: str) -> DataFrame:
    """At most HEAVY_DIGESTS values of ``column`` that include every very frequent one."""
    first = (
        digests.select(column, (F.spark_partition_id() % SKETCH_GROUPS).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate({column}, {SKETCH_ITEMS})").alias("sketch"))
    )
    top = first.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {SKETCH_ITEMS}), {HEAVY_DIGESTS})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(column)).where(F.col(column).isNotNull())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = picked(docs, id_col, text_col)
    digests = stash(rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")))
    candidates = F.broadcast(frequent_digests(digests, "text_sha256"))
    winners = (
        digests.join(candidates, "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))
        .where("heavy_size > 1")
    )
    known = digests.join(F.broadcast(winners), "text_sha256", "left")
    loses = F.col("heavy_size").isNotNull() & F.col("heavy_id").isNotNull() & (F.coalesce(F.col("doc_id") < F.col("heavy_id"), F.lit(True)))
    removed = known.where(loses).select("doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    by_digest = Window.partitionBy("text_sha256")
    rest = known.where(~loses).select(
        "doc_id",
        F.max("doc_id").over(by_digest).alias("keep_id"),
        F.coalesce("heavy_size", F.count("*").over(by_digest)).alias("group_size"),
        (F.row_number().over(by_digest.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"),
        "text_sha256",
    )
    return removed.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that agree in id and text but not in other columns, any one stays. Columns
    of any name pass through.
    """
    doc, digest, own, sha = (unused(docs, x) for x in ("doc__", "digest__", "own__", "sha__"))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha))
    tagged = docs.select("*", docs[id_col].cast("long").alias(doc), F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256).alias(digest))
    left = tagged.join(kept, F.col(doc).eqNullSafe(F.col(own)) & (F.col(digest) == F.col(sha)), "left_semi")
    return left.dropDuplicates([doc, digest]).drop(doc, digest)
