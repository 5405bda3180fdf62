"""What a task sorts doesn't grow with the paths of a walk."""

import re

from turnloom.operators import walks


def test_paths_are_dealt_before_they_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(walks, "SORTED", 50, raising=False)
    plans, kept = [], walks.kept
    monkeypatch.setattr(walks, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    e = spark.createDataFrame([("a", "x")] + [(f"b{k}", "y") for k in range(300)], "entity string, entity_type string")
    r = spark.createDataFrame([(f"r{k}{i}", "a", "to", f"b{k}") for k in range(300) for i in "pq"], "relation_id string, subject string, predicate string, object string")
    got = walks.reasoned_paths(r, e, e.where("entity = 'a'"), hops=1).collect()
    assert sorted((x.entity, x.path) for x in got) == sorted((f"b{k}", [f"r{k}p"]) for k in range(300))
    assert re.search(r"SortAggregate[^\n]*partial_min(.|\n)*?Exchange hashpartitioning\(start#\w+, entity#\w+, 12\), REPARTITION_BY_NUM", plans[-1])
