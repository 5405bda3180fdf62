"""Walks over random graphs against breadth-first loops."""

import random

import pytest

from turnloom.operators.walks import neighbours, reasoned_paths

DEEP = 5


def graph(seed):
    rng = random.Random(seed)
    entities = [(f"e{k:02d}", rng.choice(("person", "place"))) for k in range(18)]
    names = [e for e, _ in entities] + ["ghost"]
    relations = [(f"r{k:03d}", rng.choice(names), rng.choice(("knows", "lives in", "near")), rng.choice(names)) for k in range(30)]
    return entities, relations + [("r900", None, "knows", "e01"), ("r901", "e02", "near", "e02")]


def walk(entities, relations, start, target, predicates, hops):
    kinds, seen, queue, out = dict(entities), {start}, [(start, [])], {}
    while queue:
        node, path = queue.pop(0)
        if len(path) < hops:
            for rid, s, predicate, o in sorted(relations):
                if s is None or o is None or node not in (s, o) or (len(path) < len(predicates) and predicate != predicates[len(path)]):
                    continue
                other = o if s == node else s
                if other in seen or other not in kinds:
                    continue
                seen.add(other)
                queue.append((other, [*path, rid]))
                if target in (None, kinds[other]):
                    out[other] = [*path, rid]
    return out


@pytest.mark.parametrize("seed,target,predicates,hops", [(1, None, (), 3), (2, "place", ("knows", "near"), 3), (3, "person", ("knows",), 4), (4, None, ("near",), 1)])
def test_paths_and_neighbours(spark, seed, target, predicates, hops):
    entities, relations = graph(seed)
    e = spark.createDataFrame(entities, "entity string, entity_type string")
    r = spark.createDataFrame(relations, "relation_id string, subject string, predicate string, object string")
    got = {(x.start, x.entity): x.path for x in reasoned_paths(r, e, e, target, predicates, hops).collect()}
    assert got == {(s, o): p for s, _ in entities for o, p in walk(entities, relations, s, target, predicates, hops).items()}
    only = [x for x in relations if x[2] in ("knows", "near")]
    near = {(x.start, x.entity): x.hops for x in neighbours(r, e, e, hops, ("knows", "near")).collect()}
    assert near == {(s, o): len(p) for s, _ in entities for o, p in walk(entities, only, s, None, (), hops).items()}


def test_no_relations_and_an_end_of_the_graph(spark):
    e = spark.createDataFrame([(f"n{k}", "x") for k in range(4)], "entity string, entity_type string")
    r = spark.createDataFrame([(f"r{k}", f"n{k}", "next", f"n{k + 1}") for k in range(3)], "relation_id string, subject string, predicate string, object string")
    assert neighbours(r.limit(0), e, e, 3).count() == 0
    got = neighbours(r, e, e.where("entity = 'n0'"), DEEP).collect()
    assert sorted((x.entity, x.hops) for x in got) == [("n1", 1), ("n2", 2), ("n3", 3)]
