"""The registered queries of this subpackage: each applies its operator to a whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, ann_bits, bpe, ctw, exact_dedup, hyperlang, minhash_forest, packing, periodic, pii, quality, toxicity, urls
from ._tables import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_context_tree_scores(spark, sf_dir):
    return ctw.score_training_split(documents(spark, sf_dir), 7, 2)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_language(spark, sf_dir):
    return hyperlang.identify_training_split(documents(spark, sf_dir), 4, 2)


def op4_near_dedup(spark, sf_dir):
    return minhash_forest.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op5_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_quality(spark, sf_dir):
    return quality.quality_split(documents(spark, sf_dir), labels(spark, sf_dir), 5, 0)


def op7_byte_bpe(spark, sf_dir):
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_nearest(spark, sf_dir):
    return ann_bits.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op9_pii_surrogates(spark, sf_dir):
    found = [f"n_{k}" for k in pii.KINDS]
    return pii.pseudonymised(documents(spark, sf_dir)).select("doc_id", "text", *found)


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_split(documents(spark, sf_dir), labels(spark, sf_dir), 4, 2)


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(documents(spark, sf_dir))


def op12_alignment(spark, sf_dir):
    return alignment.alignment_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_url_filter(spark, sf_dir):
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.sql(urls.RULES))


QUERIES = {f.__name__: f for f in (op1_context_tree_scores, op2_exact_dedup, op3_language, op4_near_dedup, op5_packing, op6_quality, op7_byte_bpe, op8_nearest, op9_pii_surrogates, op10_toxicity, op11_periodic_runs, op12_alignment, op13_url_filter)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op13_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS x (rule_host, rule_path, verdict)),
        f AS (SELECT p.host, p.path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
              FROM (SELECT DISTINCT host, path FROM p) AS p JOIN r ON (p.host = rule_host OR suffix(p.host, '.' || rule_host)) AND prefix(p.path, rule_path) GROUP BY p.host, p.path)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
    """,
}

