"""Common neighbours: more tasks where there are more pairs, and the rows of the SQL."""

from turnloom.operators import graph
from turnloom.sql import render


def test_tasks_grow_with_pairs_and_rows_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 50)
    rows = [(s, p) for p in range(40) for s in range(12) if (s * p) % 5 < 3] * 2 + [(None, 1), (3, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    got, want = graph.common_neighbours(spark, str(tmp_path)), spark.sql(render(graph.COMMON, 0))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert got.rdd.getNumPartitions() > 4
