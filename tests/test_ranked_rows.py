"""Lexical rankings dealt by row: small bounds change nothing, and a task's points are summed where they arise."""

import duckdb
import pytest

from turnloom.plans import evidence
from turnloom.registry import ORACLE_SQL, QUERIES

TALK = ["The gardens by the river; garden tools", "river rivers riverside", None, "", "Don't paint the Garden", "gardening river", "so it is"]


@pytest.mark.parametrize("name", ["o200_rank_by_lexical", "o203_search_episodes"])
def test_small_bounds_give_the_same_ranks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(evidence, "ROWS", 3)
    monkeypatch.setattr(evidence, "MEETS", 4)
    turns = [(c, t, "user", TALK[(c * 5 + t * 3) % 7]) for c in range(9) for t in range(3)]
    if name == "o200_rank_by_lexical":  # Rows of one key are one row to be ranked.
        turns += [(1, 1, "user", "garden river"), (1, 1, "user", "rivers"), (None, 1, "user", "garden river")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = [(0, "Which garden lies by the river river?"), (1, "paint"), (2, ""), (3, None), (4, "tools of a riverside garden, gardening"), (5, "unheard")]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name])
    assert got.columns == want.columns
    assert len(rows := got.collect()) > 9
    # Where a null key ties, the engines sort it at different ends: scores are compared for all rows, keys for those without one.
    assert sorted((r.item_id, r.rnk, round(r.score, 9)) for r in rows) == sorted((x[0], x[-1], round(x[-2], 9)) for x in want.fetchall())
    if all(t[0] is not None for t in turns):
        assert sorted(map(tuple, rows)) == sorted(con.sql(ORACLE_SQL[name]).fetchall())
