"""Verdicts on predictions and scores of benchmarks, against plain Python."""

import math
import re

from pyspark.sql import functions as F

from turnloom.plans import judging

CASES = [
    (None, "x"), ("", ""), ("0", "0"), (" 0 ", "no"), ("Yes, it is.", "yes"), ("certainly not", "no"), ("that is true", "no"), ("对的", "yes"), ("The Cat", " the cat\n"), ("cat", ""), ("a cat sat", "cat"), ("in 1999 maybe", "1999 or 2000"), ("12 apples", "the 12th of may"), ("in 7 days", "8 days"),
    ("the is are", "the was"), ("red big house", "house of the big red dog owner person"), ("one of the", "two of the"), ("alpha beta", "beta gamma delta epsilon"), ("wide　space here", "here space lies"), ("nothing", None), ("x", "the"), ("of this", "in this case of those"),
]
KINDS = ("yes_no", "short_answer", "abstractive", None)
STOPS = set("the a an is are was were be been being have has had do does did will would should could may might must can".split())
MORE = set("this that these those in on at to for of with by".split())


def verdict(pred, ref, kind):
    if not pred:
        return False
    pred, ref = pred.strip().lower(), (ref or "").strip().lower()
    if not pred or pred == "0":
        return False
    if pred == ref or ref in pred or pred in ref:
        return True
    if kind == "yes_no" or ref in ("yes", "no"):
        return any(w in pred for w in ("yes", "true", "correct", "是", "对的")) == (ref == "yes")
    stops = STOPS if kind == "short_answer" else STOPS | MORE
    if kind == "short_answer" and set(re.findall(r"\d+", pred)) & set(re.findall(r"\d+", ref)):
        return True
    p, r = set(pred.split()) - stops, set(ref.split()) - stops
    return bool(r) and len(p & r) / len(r) > (0.3 if kind == "short_answer" else 0.2)


def test_verdicts_and_scalars(spark):
    rows = [(i, p, a, k) for i, (p, a) in enumerate(CASES) for k in KINDS]
    df = spark.createDataFrame(rows, "i int, p string, a string, kind string")
    p, a = F.col("p"), F.col("a")
    for r in df.select("*", judging.correct(p, a, F.col("kind")).alias("ok"), judging.partial(p, a).alias("half"), judging.overlap(p, a).alias("o"), judging.word_f1(p, a).alias("f")).collect():
        assert r.ok == verdict(r.p, r.a, r.kind), r
        x, y = ((t or "").lower().strip() for t in (r.p, r.a))
        assert r.half == (1 if x == y else 0.5 if x in y or y in x else 0), r
        x, y = set(x.split()), set(y.split())
        assert math.isclose(r.o, len(x & y) / len(y) if y else 0), r
        assert (r.f is None) == (not y) and (not y or math.isclose(r.f, 2 * len(x & y) / (len(x) + len(y)))), r


def test_scores_by_group_and_element(spark):
    rows = [("a", ["s", "t"], 1.0), ("a", [], 0.0), (None, ["t"], None), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, many array<string>, ok double")
    got = {(r["grouping"], r["value"]): (r["n"], r["m"]) for r in judging.scores(df, {"m": F.col("ok")}, {"g": F.col("g")}, {"e": F.col("many")}).collect()}
    assert got == {("all", ""): (4, 0.666666667), ("g", "a"): (2, 0.5), ("g", "unknown"): (1, None), ("g", "b"): (1, 1.0), ("e", "s"): (1, 1.0), ("e", "t"): (2, 1.0)}
    assert [tuple(r) for r in judging.scores(df.limit(0), {"m": F.col("ok")}, {"g": F.col("g")}).collect()] == [("all", "", 0, None)]


def test_recall_and_reciprocal_rank(spark):
    lists = [([3, 1, 2, 1], [1, 1, 9]), ([], [1]), ([1], []), ([5, 4], [4, 5]), ([7, 8], [9])]
    df = spark.createDataFrame(lists, "got array<long>, want array<long>")
    rows = df.select("*", *(judging.recall_at(F.col("got"), F.col("want"), k).alias(f"r{k}") for k in (1, 2, 5)), judging.reciprocal_rank(F.col("got"), F.col("want")).alias("rr")).collect()
    for r in rows:
        for k in (1, 2, 5):
            assert r[f"r{k}"] == (len(set(r.got[:k]) & set(r.want)) / len(set(r.want)) if r.want else None)
        assert r.rr == next((1 / i for i, x in enumerate(r.got, 1) if x in r.want), 0)


def test_keyword_search(spark):
    rows = [(i, "ab"[i % 2], ["Cat", None] if i % 3 == 0 else None if i % 3 == 1 else ["dog"], "A catalogue of DOGS" if i % 4 == 0 else None if i % 4 == 1 else "dog") for i in range(40)]
    got = judging.keyword_search(spark.createDataFrame(rows, "id int, tenant string, keywords array<string>, text string"), ["CAT", "dog"], 7, ["tenant"])
    points = lambda ks, t: sum(2 * (w in [k.lower() for k in ks or [] if k]) + (w in (t or "").lower()) for w in ("cat", "dog"))
    for tenant in "ab":
        best = sorted((-points(ks, t), i) for i, own, ks, t in rows if own == tenant and points(ks, t))[:7]
        assert [(r.id, r.score) for r in sorted(got.where(f"tenant = '{tenant}'").collect(), key=lambda r: r.rnk)] == [(i, -s) for s, i in best]
    assert judging.keyword_search(spark.createDataFrame(rows, "id int, tenant string, keywords array<string>, text string"), []).count() == 0
