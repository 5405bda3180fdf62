"""Exact nearest rows against the SQL that compares all pairs: copies, ties, null, zero and extreme vectors; and no plan that joins all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators.nearest import exact_nearest
from turnloom.plans.retrieval import KNN
from turnloom.plans.searches import L2, THRESHOLD
from turnloom.registry import QUERIES
from turnloom.sql import render

SQL = {"o214_l2_neighbours": L2, "o217_cosine_threshold": THRESHOLD, "o218_knn_cosine": KNN}


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i]], i % 3) for i in range(700)]
    rows += [(1000 + 5 * i, rows[7][1], 0) for i in range(60)] + [(2000 + i, [2 * x for x in rows[20 + i][1]], 0) for i in range(40)]
    rows += [(3000 + i, [float(x) for x in rng.integers(-1, 2, 6)], 0) for i in range(300)]
    rows = [(i, v if any(v) else [1.0] * 6, k) for i, v, k in rows]
    rows += [(4000, None, 0), (4001, None, 0), (4020, [None] + rows[0][1][1:], 0), (4003, [float("nan")] * 6, 0), (4040, [float("nan")] + [1.0] * 5, 0), (4060, [1e30] * 6, 0), (4007, [1e30, -1e30, 1e30, 1.0, 1.0, 1.0], 0)]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_all_pairs(spark, odd_vectors, name):
    spark.read.parquet(f"{odd_vectors}/embeddings.parquet").createOrReplaceTempView("embeddings")
    want = spark.sql(render(SQL[name], 0))
    got = QUERIES[name](spark, odd_vectors)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_join_of_all_pairs(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_zero_vectors_and_few_rows(spark):
    rows = [(0, [0.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_nearest(table, F.col("vec_id") % 20 == 0, 5, "l2", nulls=False).collect()
    assert [(r.query_id, r.vec_id, r.score, r.rnk) for r in got] == [(20, 3, 2.236068, 1)]
    assert exact_nearest(table.limit(0), F.col("vec_id") % 20 == 0, 5, "cosine").collect() == []
