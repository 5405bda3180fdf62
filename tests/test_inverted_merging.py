"""The stored index against exhaustive BM25, merging of similar entries against a loop."""

import collections
import math
import random
import re

import numpy as np
import pytest

from turnloom.operators import merging
from turnloom.operators.merging import merged
from turnloom.plans import inverted


def okapi(units, question, k):
    docs = {i: [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) > 1] for i, text, status in units if status != "ARCHIVED" and i is not None}
    docs = {i: d for i, d in docs.items() if d}
    mean = sum(map(len, docs.values())) / len(docs) if docs else 1
    df = collections.Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    average = sum(idf.values()) / len(idf) if idf else 0
    idf = {t: 0.25 * average if v < 0 else v for t, v in idf.items()}
    out = []
    for i, d in docs.items():
        tf = collections.Counter(d)
        s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in re.findall("[a-z0-9]+", (question or "").lower()) if t in tf)
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("block", [4096, 3])
def test_index_equals_exhaustive_bm25(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(inverted, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"w{k}" for k in range(60)]
    units = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 30))), "ARCHIVED" if i % 9 == 0 else rng.choice(["ACTIVE", None])) for i in range(300)] + [(500, None, "ACTIVE"), (501, "", "ACTIVE"), (502, "x y z", "ACTIVE"), (None, "w1 w2", "ACTIVE")]
    questions = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))) for q in range(25)] + [(90, "w3 w3 W3 unknown"), (91, "nothing known"), (92, ""), (93, None), (94, "w0")]
    inverted.build(spark.createDataFrame(units, "id long, text string, status string").repartition(4), str(tmp_path))
    got = collections.defaultdict(list)
    for r in inverted.search(inverted.opened(spark, str(tmp_path)), spark.createDataFrame(questions, "q long, text string"), 5).orderBy("q", "rnk").collect():
        got[r.q].append((r.id, r.score))
    for q, text in questions:
        want = okapi(units, text, 5)
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)
        assert [i for i, _ in got[q]] == [i for i, _ in want] or len({round(s, 5) for _, s in want}) < len(want)
    assert got[91] == got[92] == got[93] == []
    plan = inverted.opened(spark, str(tmp_path))[0].where("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_empty_index(spark):
    empty = spark.createDataFrame([], "id long, text string, status string")
    assert inverted.search(inverted.postings_of(empty), spark.createDataFrame([(1, "a b")], "q long, text string")).count() == 0


def brute(rows, least):
    usable = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    order = sorted(usable, key=lambda i: (-(next(w for j, _, w in rows if j == i) or 0), i))
    fate, alive = {i: None for i, _, _ in rows}, []
    for i in order:
        for j in alive:
            if len(usable[j]) == len(usable[i]) and usable[i] @ usable[j] >= least - 1e-12:
                fate[i] = j
                break
        else:
            alive.append(i)
    return fate


@pytest.mark.parametrize("chunk,n", [(512, 2000), (16, 250)])
def test_merged_entries_equal_a_loop(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(merging, "CHUNK", chunk)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 12, 24))
    vectors = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, 24)) * rng.choice([0.0, 0.1, 0.2, 0.25], size=n)[:, None]
    rows = [(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(vectors, rng.integers(0, 5, size=n)))]
    rows += [(n, None, 9.0), (n + 1, [], 9.0), (n + 2, [0.0] * 24, 1.0), (n + 3, [float("nan")] * 24, 1.0), (n + 4, [1.0, 2.0], None), (n + 5, [2.0, 4.0], 1.0), (n + 6, (vectors[0] * 1e-9).tolist(), None)]
    got = {r.id: r.superseded_by for r in merged(spark.createDataFrame(rows, "id long, vector array<double>, importance double").repartition(4)).collect()}
    want = brute(rows, 0.95)
    assert got == want and sum(v is not None for v in want.values()) > n // 10


def test_merging_an_empty_table(spark):
    assert merged(spark.createDataFrame([], "id long, vector array<double>, importance double")).count() == 0
