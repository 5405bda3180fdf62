"""Queries against DuckDB on the smallest tables, and folds against plain Python."""

import math

import duckdb
import numpy as np
import pytest

from turnloom.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from turnloom.sql import TABLES, render
from turnloom.streaming.events import anchored

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name,key,k", [("o214_l2_neighbours", "dist", 5), ("o217_cosine_threshold", "cosine", 10)])
def test_searches_cover_every_twentieth_row_and_all_labels(spark, name, key, k):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r.anchor_id, {})[r.vec_id] = r[key]
    want = {}
    for q in (v for v in vectors if v % 20 == 0):
        a, others = vectors[q], [v for v in vectors if v != q]
        score = {v: float(np.linalg.norm(a - vectors[v])) if key == "dist" else float(a @ vectors[v] / np.linalg.norm(a) / np.linalg.norm(vectors[v])) for v in others}
        best = sorted(others, key=lambda v: (round(score[v] if key == "dist" else -score[v], 6), v))[:k]
        hits = {v: score[v] for v in best if key == "dist" or round(score[v], 6) >= 0.1}
        if hits:
            want[q] = hits
    assert {q: set(h) for q, h in got.items()} == {q: set(h) for q, h in want.items()}
    assert all(math.isclose(got[q][v], want[q][v], abs_tol=2e-6) for q in want for v in want[q])


CASES = [
    ("the cat sat", "The cat, sat!"), (None, "x"), ("", ""), ("a an the", "the"), ("我爱北京", "北京 ok"), ("go go go stop", "go stop"), ("Iechä da", "iechä"), ("日本語 test１", "日本 test"),
    ("one, two; three", "two two three four"), ("it's", "its"), ("and so on", "so on"), ("全角！标点", "全角标点"), ("  spaced\tout\nwords ", "words out"), ("x", "y"), ("?!", "..."), ("한국어 말", "한국말"),
]


def plain_tokens(text):
    import re
    import unicodedata

    cjk = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
    low = "".join(" " if unicodedata.category(c).startswith("P") or c in "$+<=>^`|~" else c for c in (text or "").lower())
    chunks = [re.findall(f"[a-z0-9]+|[{cjk}]", c) if re.search(f"[{cjk}]", c) else [c] for c in low.split()]
    return [t for c in chunks for t in c if t not in ("a", "an", "the")]


def test_answer_scores_on_fixtures(spark, tmp_path):
    """Nulls, empty texts, articles, repeated words and texts without spaces, against plain Python."""
    import collections
    import re

    rows = [(k, t, r, x) for k, pair in enumerate(CASES) for t, r, x in ((0, "user", pair[0]), (1, "assistant", pair[1]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {name: {r.conv_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("o274_answer_set_f1", "o275_smoothed_bleu1", "o282_bag_f1_of_quoted_words")}
    for k, (gold, said) in enumerate(CASES):
        g, s = plain_tokens(gold), plain_tokens(said)
        both = len(set(g) & set(s))
        assert math.isclose(got["o274_answer_set_f1"][k].f1, 2 * both / (len(set(g)) + len(set(s))) if g and s else 0, abs_tol=1e-9)
        m = sum((collections.Counter(g) & collections.Counter(s)).values())
        assert math.isclose(got["o275_smoothed_bleu1"][k].bleu1, m / len(s) * (1 if len(s) > len(g) else math.exp(1 - len(g) / len(s))) if m else 0, abs_tol=1e-9)
        g, s = (re.findall("[a-z0-9']+", (x or "").lower()) for x in (gold, said))
        m = sum((collections.Counter(g) & collections.Counter(s)).values())
        assert math.isclose(got["o282_bag_f1_of_quoted_words"][k].f1, 1 if not g and not s else 2 * m / (len(g) + len(s)) if m else 0, abs_tol=1e-9)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_anchored_window_counts_from_first_event():
    assert anchored([0, 1799, 1800, 1801, 3600, 10]) == [0, 0, 1, 1, 2, 2]


def test_render_fills_both_dialects():
    assert render("{size({words(x)})}", 0).startswith("size(regexp") and render("{size({words(x)})}", 1).startswith("len(")
