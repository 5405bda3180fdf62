"""The evidence store, the ordered fold and redaction against plain Python."""

import collections
import datetime
import re

import pytest

from turnloom.functions.routes import SECRETS, redacted
from turnloom.plans.evidence import STOP
from turnloom.registry import QUERIES
from turnloom.streaming.events import anchored

STOPS = set(re.findall("'([a-z]+)'", STOP))
TEXTS = ["The garden was painted blue by Marta", None, "", "gardening gardening tools, garden's edge", "日本語 only", "painters painted; the painter PAINTED", "blue", "a an the of"]
ASKED = ["who painted the garden blue", "paint garden garden", "the of", "日本", "paint’s tools and edges"]


def content(text):
    return [t for t in re.findall("[a-z0-9][a-z0-9']*", (text or "").lower()) if len(t) > 2 and t not in STOPS]


def plain_score(question, text):
    q, t = content(question), collections.Counter(content(text))
    if not q:
        return 0
    shared = sum((collections.Counter(q) & t).values())
    return shared / len(q) + 0.05 * sum(len(w) >= 5 and w in (text or "").lower() for w in set(q))


def test_lexical_ranking(spark, tmp_path):
    spark.createDataFrame([(k // 4, k % 4, "user", t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.conv_id * 4 + r.turn): r.score for r in QUERIES["o200_rank_by_lexical"](spark, str(tmp_path)).collect()}
    want = {(i, k): plain_score(q, t) for i, q in enumerate(ASKED) for k, t in enumerate(TEXTS)}
    want = {k: s for k, s in want.items() if s > 0}
    assert got == pytest.approx(want, abs=1e-8) and len(want) >= 5


@pytest.mark.parametrize("rows", [[4], [1] * 20, [3, 9, 2, 1], [12, 1, 8]])
def test_edges_join_the_last_eight(spark, tmp_path, rows):
    talk = [(0, k, "user", " ".join(f"Note {k} {i}." for i in range(n))) for k, n in enumerate(rows)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.l, r.r) for r in QUERIES["o123_window_edges"](spark, str(tmp_path)).where("edge_type <> 'source_of'").collect())
    want, read = set(), 0
    for n in rows:
        read += n
        window = range(max(1, read - 7), read + 1)
        want |= {(a, b) for a in window for b in window if a != b}
    assert got == sorted(want)


def test_anchored_windows_over_runs(spark, tmp_path):
    at = {1: [0, 1799, 1800, 1801, 3600, 3601, 9000, 9000], 2: [5], None: [10, 1811, 20], 3: [k * 700 for k in range(40)]}
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, s) for u, seconds in at.items() for s in seconds]
    table = [(k, start + datetime.timedelta(seconds=s), u) for k, (u, s) in enumerate(rows)] + [(999, None, 1)]
    spark.createDataFrame(table, "event_id long, ts timestamp, user_id long").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(((r.user_id, r.window_no, r.n, r.first_id, r.last_id) for r in QUERIES["o372_anchored_windows"](spark, str(tmp_path)).collect()), key=repr)
    want = []
    for u in at:
        mine = sorted((s, k) for k, (v, s) in enumerate(rows) if v == u)
        numbers = anchored([s for s, _ in mine])
        for n in set(numbers):
            ids = [k for (_, k), m in zip(mine, numbers) if m == n]
            want.append((u, n, len(ids), min(ids), max(ids)))
    assert got == sorted(want, key=repr)


def test_redaction(spark):
    texts = ["sk-" + "a" * 24, "password: hunter22 ok", "Bearer abc.def", "nothing", None, "", "x" * 32 + "==", "token=" + "Z" * 30, "password 我爱北京天安门"]
    got = redacted(spark.createDataFrame(list(enumerate(texts)), "k long, text string")).orderBy("k").collect()
    for row, text in zip(got, texts):
        want = text or ""
        for pattern, put in SECRETS:
            want = re.sub(pattern, put, want)
        assert (row.text, row.redaction) == (want, "none" if want == (text or "") else "partial")
