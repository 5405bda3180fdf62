"""A narrow frontier goes to the relations; the relations are not shuffled for it."""

import re

import pytest

from turnloom.operators import walks


@pytest.mark.parametrize("narrow", [1 << 18, 0])
def test_relations_stay_where_they_are(spark, monkeypatch, narrow):
    monkeypatch.setattr(walks, "NARROW", narrow, raising=False)
    plans, kept = [], walks.kept
    monkeypatch.setattr(walks, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    e = spark.createDataFrame([(x, "") for x in "abcdf"] + [("b", "again")], "entity string, entity_type string")
    r = spark.createDataFrame([("1", "a", "to", "b"), ("2", "b", "to", "c"), ("3", "b", "to", "x"), ("4", "x", "to", "d"), ("5", "a", "to", "a"), ("6", "f", "by", "b"), ("7", None, "to", "b")], "relation_id string, subject string, predicate string, object string")
    starts = spark.createDataFrame([("a",), ("x",)], "entity string")
    got = sorted(map(tuple, walks.neighbours(r, e, starts, 2).collect()))
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "f", 2), ("x", "a", 2), ("x", "b", 1), ("x", "c", 2), ("x", "d", 1), ("x", "f", 2)]
    assert sorted(map(tuple, walks.neighbours(r, e, starts, 2, ["to"]).collect())) == [t for t in got if t[1] != "f"]
    if narrow:
        assert len(plans) > 2
        assert not any(re.search(r"Exchange hashpartitioning\((node|other)#", p) for p in plans)
