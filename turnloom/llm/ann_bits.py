"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Every unit vector is rotated at random and kept as the signs of its coordinates, packed
into bytes, with two correction scalars: its inner product with its own code, and its
norm. For a rotated query, <code, query> / <code, vector> estimates the cosine without
bias, and its error is at most BOUND * sqrt((1 - c*c) / c*c) / sqrt(d - 1) with high
probability, c being the first scalar. Only vectors whose estimate plus bound reaches
the query's k-th best exact cosine so far are reranked in double precision.

At scale: the index is one table, no model is fitted. Queries go in blocks of about
BLOCK rows (checked size), one block at a time: it is broadcast to a scan of the index,
its hits are written, and it is released before the next. Every task keeps k rows per
query, so the last step sees tasks x queries x k rows, whatever the corpus.

Defined cases: vectors that are null, zero, or hold null or non-finite components take
no part. Vectors are compared with those of their own length. An id that is queried
with several vectors asks with the least of them. Equal scores go to the smaller id. A query's own id is never among its answers, also
where rows repeat it. Repeated rows are answers each. Null ids take no part. Fewer
than k candidates: all are returned. Other columns are ignored.
"""

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import stash

#: Width of the error bound in standard deviations; rows of a query block; seed of the rotation.
BOUND, BLOCK, SEED = 3.5, 4096, 29
#: Index rows compared with the queries at once inside a task; pairs reranked at once.
ROWS, PAIRS = 512, 1 << 15
HITS = "query_id long, vec_id long, score double"


def rotation(d):
    """A random orthogonal d x d matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scaled(vectors):
    """Each row times the power of two that brings its largest component near one: no angle changes, no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _codes(d):
    def run(batches):
        import pyarrow as pa

        turn = rotation(d)
        for batch in batches:
            if not len(batch):
                continue
            vectors = scaled(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(batch), d))
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            turned = (vectors / norms[:, None]) @ turn.T
            bits = np.packbits(turned >= 0, axis=1)
            own = np.abs(turned).sum(axis=1) / np.sqrt(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * d, pa.int32()), pa.array(vectors.ravel())), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(own), pa.array(norms)], ["vec_id", "vector", "code", "own", "norm"])

    return run


def best(ids, scores, k):
    """Positions of the k best: largest score first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(block, d, k):
    def run(batches):
        import pyarrow as pa

        query_ids, queries = block.value
        turn = rotation(d)
        query_norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        turned = ((queries / query_norms[:, None]) @ turn.T).astype(np.float32)
        n = len(query_ids)
        top_ids, top_scores = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        floor = np.full(n, -np.inf)

        def rerank(rows, cols, ids, vectors, norms):
            for s in range(0, len(rows), PAIRS):
                rerank_some(rows[s : s + PAIRS], cols[s : s + PAIRS], ids, vectors, norms)

        def rerank_some(rows, cols, ids, vectors, norms):
            scores = np.einsum("ij,ij->i", vectors[rows], queries[cols]) / (norms[rows] * query_norms[cols])
            order = np.argsort(cols, kind="stable")
            rows, cols, scores = rows[order], cols[order], scores[order]
            heads = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]])) if len(cols) else []
            for a, b in zip(heads, [*heads[1:], len(cols)], strict=False):
                q = cols[a]
                all_ids, all_scores = np.concatenate([top_ids[q], ids[rows[a:b]]]), np.concatenate([top_scores[q], scores[a:b]])
                keep = best(all_ids, all_scores, k)
                top_ids[q], top_scores[q] = all_ids[keep], all_scores[keep]
                if len(keep) == k:
                    floor[q] = top_scores[q][-1]

        for batch in batches:
            for s in range(0, len(batch), ROWS):
                part = batch.slice(s, ROWS)
                ids = np.asarray(part.column(0))
                vectors = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(part), d)
                own, norms = np.asarray(part.column(3)), np.asarray(part.column(4))
                packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
                estimate = (signs @ turned.T) / (np.sqrt(d) * own)[:, None]
                error = BOUND * np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(max(d - 1, 1))
                estimate[ids[:, None] == query_ids] = -np.inf
                first = min(2 * k, len(part))
                likely = np.argpartition(-estimate, first - 1, axis=0)[:first]
                rows, cols = likely.ravel(), np.tile(np.arange(n), first)
                ok = np.isfinite(estimate[rows, cols]) & (estimate[rows, cols] + error[rows] >= floor[cols])
                rerank(rows[ok], cols[ok], ids, vectors, norms)
                estimate[likely, np.arange(n)] = -np.inf
                rows, cols = np.nonzero(estimate + error[:, None] >= floor - 1e-9)
                ok = np.isfinite(estimate[rows, cols])
                rerank(rows[ok], cols[ok], ids, vectors, norms)
        counts = [len(x) for x in top_ids]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate([*top_ids, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*top_scores, np.zeros(0)]))], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, as far as one row can tell."""
    whole = F.col("vector")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & whole.isNotNull() & (F.size(whole) > 0)).where(finite).where(F.exists(whole, lambda x: x != 0))


def _hits(rows, d, is_query, k):
    """Hits (query_id, vec_id, score) of each block of queries among rows of length d, written one block after the other."""
    context = rows.sparkSession.sparkContext
    index = stash(rows.mapInArrow(_codes(d), "vec_id long, vector array<double>, code binary, own double, norm double"))
    queries = stash(index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks = -(-queries.count() // BLOCK)
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if len(own):
            block = context.broadcast((np.asarray(own.column("vec_id")), np.array([np.asarray(v.values, dtype=np.float64) for v in own.column("vector")])))
            yield stash(index.mapInArrow(_search(block, d, k), HITS))
            block.destroy()


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row where ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], HITS)
    found = [hits for r in rows.select(F.size("vector").alias("d")).distinct().orderBy("d").collect() for hits in _hits(rows.where(F.size("vector") == r["d"]), r["d"], is_query, k)]
    if not found:
        return empty.selectExpr("query_id", "0 as rank", "vec_id", "score")
    found = functools.reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
