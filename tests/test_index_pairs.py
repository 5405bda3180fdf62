"""Searches of the index sum the pairs of questions and units where they arise."""

import random
import re

from test_inverted_merging import okapi

from turnloom.plans import inverted
from turnloom.sql import kept


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(inverted, "PAIRS", 5000, raising=False)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(30)]
    units = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 12))), "ACTIVE") for i in range(400)]
    questions = [(q, " ".join(rng.choices(vocabulary, k=12))) for q in range(100)]
    index = inverted.postings_of(spark.createDataFrame(units, "id long, text string, status string"))
    index, asked = tuple(kept(t) for t in index), kept(spark.createDataFrame(questions, "q long, text string"))
    found = inverted.search(index, asked, 5)
    assert not re.search(r"hashpartitioning\(q#\w+, (id|_groupingexpression)#", found._jdf.queryExecution().executedPlan().toString())
    got = {(r.q, r.rnk): r.score for r in found.collect()}
    for q, text in questions[:10]:
        assert [round(got[q, n], 4) for n in range(1, 6)] == [round(s, 4) for _, s in okapi(units, text, 5)]


def test_counts_of_sorted_terms(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (1, ["c"]), (2, ["a", "b", "b", "b"])], "id long, toks array<string>")
    got = sorted(map(tuple, inverted.counts(rows).select("id", "size", "term", "tf").collect()))
    assert got == [(1, 1, "c", 1), (1, 3, "a", 2), (1, 3, "b", 1), (2, 4, "a", 1), (2, 4, "b", 3)]
