"""Recurrences over partitions against sequential loops."""

import collections
import math
import random

import pytest

from turnloom.operators import recurrences
from turnloom.operators.recurrences import adaptive_threshold, posteriors, running, smoothed


def test_running_values_equal_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for k, n in ((0, 700), (1, 3), (2, 1), (None, 40), (3, 200)):
        for i in range(n):
            rows.append((k, i, rng.choice([None, 1.0, 0.9, 0.0, 1.2]), rng.choice([None, rng.uniform(-1, 1)]), rng.choice([None, -2.0, 0.1]), rng.choice([None, 2.0, 1.5]), "x"))
    df = spark.createDataFrame(rows + [(1, None, 1.0, 1.0, None, None, "x")], "k long, i long, a double, b double, lo double, hi double, _scale string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): r.value for r in running(df.drop("_scale"), "k", "i", df.a, df.b, 0.3, df.lo, df.hi).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, at = {}, {}
    for k, i, a, b, lo, hi, _ in rows:
        x = (1.0 if a is None else a) * at.get(k, 0.3) + (b or 0.0)
        at[k] = min(math.inf if hi is None else hi, max(-math.inf if lo is None else lo, x))
        want[k, i] = at[k]
    assert got == pytest.approx(want, abs=1e-9)
    assert running(df.limit(0), "k", "i", 1.0, 1.0).count() == 0


def test_steps_compose():
    rng = random.Random(2)
    for _ in range(2000):
        steps = [(rng.choice([0.0, 0.5, 1.0, 1.3]), rng.uniform(-2, 2), *sorted((rng.choice([-math.inf, rng.uniform(-3, 0)]), rng.choice([math.inf, rng.uniform(0, 3)])))) for _ in range(4)]
        whole, x = steps[0], rng.uniform(-5, 5)
        for s in steps[1:]:
            whole = recurrences.then(whole, s)
        y = x
        for a, b, lo, hi in steps:
            y = min(hi, max(lo, a * y + b))
        assert min(whole[3], max(whole[2], whole[0] * x + whole[1])) == pytest.approx(y, abs=1e-9)


def test_posteriors_equal_a_loop(spark):
    rng = random.Random(3)
    arms = {"fact": ["vector", "graph", "hybrid"], "time": ["vector", "graph"]}
    rows = [(rng.choice(list(arms)), i, rng.choice(["vector", "graph", "hybrid", "none"]), rng.random() < 0.6, rng.random()) for i in range(400)]
    state, want = {(k, s): [1.0, 1.0] for k, ss in arms.items() for s in ss}, {}
    for kind, i, s, good, quality in rows:
        if (kind, s) not in state:
            continue
        state[kind, s][0 if good else 1] += quality if good else 1 - quality
        for other in arms[kind]:
            if other != s:
                state[kind, other] = [max(1.0, x * 0.99) for x in state[kind, other]]
        want |= {(kind, other, i): tuple(state[kind, other]) for other in arms[kind]}
    got = posteriors(spark.createDataFrame(rows, "kind string, at long, strategy string, success boolean, quality double"), spark.createDataFrame([(k, s) for k, ss in arms.items() for s in ss], "kind string, strategy string"))
    got = {(r.kind, r.strategy, r["at"]): (r.alpha, r.beta) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_thresholds_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.1 else rng.random()) for k in "ab" for i in range(150)]
    state, want = collections.defaultdict(lambda: [0.5, 0.9, 0]), {}
    for k, i, v in rows:
        s = state[k]
        s[0] = s[0] if v is None else 0.95 * s[0] + 0.05 * v
        s[2] += 1
        if s[2] >= 20 and s[2] % 10 == 0:
            s[1] = max(0.85, min(0.95, s[1] + 0.5 * (s[0] - 0.45)))
        want[k, i] = (s[0], s[1])
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): (r.smoothed, r.threshold) for r in adaptive_threshold(df, "k", "i", "v", 0.45, 0.5, 0.9, 0.85, 0.95, 10, 20).collect()}
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want) and len(got) == 300
    assert smoothed(df, "k", "i", "v").columns == ["k", "i", "v", "smoothed"]


def test_posteriors_pass_over_the_rows_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(recurrences, "kept", lambda df: written.append(df) or df.localCheckpoint())
    outcomes = spark.createDataFrame([("k", i, "ab"[i % 2], i % 3 == 0, 0.5) for i in range(20)], "kind string, at long, strategy string, success boolean, quality double")
    got = posteriors(outcomes, spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, strategy string"))
    assert got.count() == 40 and len(written) == 1
