"""Budgets against loops; the growing store against stores built at once."""

import collections
import datetime
import random

import pytest

from turnloom.plans.bundles import SkippingBudget, rendered, tiered
from turnloom.plans.evidence import STORE
from turnloom.registry import QUERIES
from turnloom.sql import run_steps
from turnloom.streaming.folds import fold_table
from turnloom.streaming.store import add_turns, components_at, ingest, turns_at, versions


def test_tiers_and_bundles_equal_loops(spark):
    rng = random.Random(8)
    rows = [(s, rng.randint(1, 3), p, p, " ".join(["w"] * rng.choice([0, 1, 2, 3, 9]))) for s in range(12) for p in range(rng.randint(0, 14))] + [(50, 1, 0, 0, None), (50, 2, 1, 1, "a\nb  c"), (51, 1, 0, 0, "x " * 100), (51, 2, 1, 1, "fits")]
    taken = collections.defaultdict(list)
    for s in {r[0] for r in rows}:
        left = 15
        for tier in (1, 2, 3):
            for _, _, p, _, text in sorted(r for r in rows if r[0] == s and r[1] == tier):
                cost = len((text or "").split())
                if cost > left:
                    break
                left -= cost
                taken[s].append((tier, p, cost))
    items = spark.createDataFrame(rows, "scope long, tier int, place long, item long, text string")
    got = collections.defaultdict(list)
    out = tiered(items, 15)
    for r in out.collect():
        got[r.scope].append((r.tier, r.item, r.cost))
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in taken.items()}
    texts = {(r[0], r[3]): r[4] or "" for r in rows}
    bundles = {r.scope: r.bundle for r in rendered(out.drop("tier", "cost").join(items, ["scope", "item"]), 10).collect()}
    heads = {1: "Session summaries:", 2: "Timeline observations:", 3: "Relevant memory entries:"}
    for s, mine in taken.items():
        lines, used = [], 0
        for tier in (1, 2, 3):
            part = [f"- {texts[s, p]}" for t, p, _ in sorted(mine) if t == tier]
            for line in ([heads[tier]] if part else []) + part:
                if used + len(line.split()) <= 10:
                    used += len(line.split())
                    lines.append(line)
        assert bundles[s] == "\n".join(lines)


def test_budget_that_skips_beyond_a_hundred_rows(spark):
    rng = random.Random(9)
    rows = [(k, i, i, rng.randint(1, 60)) for k in (0, 1) for i in range(400)]
    got = collections.defaultdict(list)
    for r in fold_table(spark.createDataFrame(rows, "k long, i long, item long, cost long"), "k", "i", SkippingBudget(3000)).orderBy("k", "i").collect():
        got[r.k].append((r.item, r.used))
    for k in (0, 1):
        used, want = 0, []
        for _, i, _, c in [r for r in rows if r[0] == k]:
            if used + c <= 3000:
                used += c
                want.append((i, used))
        assert got[k] == want


def test_ancestors_of_long_conversations(spark, tmp_path):
    rows = [(0, t, "user", "x") for t in range(300)] + [(1, t, "user", "x") for t in (0, 1, 3, 4)] + [(2, 5, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.root, r.depth) for r in QUERIES["o137_ancestors"](spark, str(tmp_path)).collect())
    assert got == [(0, t, 0, t) for t in range(300)] + [(1, 0, 0, 0), (1, 1, 0, 1)]
    assert QUERIES["o229_budget_that_skips"](spark, str(tmp_path)).where("conv_id = 0").count() == 12


def test_scripts_are_parsed_by_colons(spark, tmp_path):
    rows = [(0, 0, "Ann", "Hello: there\ncarry, on\n\nTeleplay: by nobody\nBob : hi"), (0, 1, None, None), (1, 0, "", "no: name")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn_, r.lines_, r.speaker, r.utterance) for r in QUERIES["o010_parse_turns"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 2, "Ann", "Hello: there\ncarry, on"), (0, 2, 1, "Bob", "hi"), (0, 3, 1, "", ""), (1, 1, 1, "", "no: name")]


SCHEMA = "scope long, episode long, turn long, speaker string, text string, said_on date"
DAY = datetime.date(2024, 2, 28)
BATCHES = [
    [(0, 0, 0, "Ann", "Marta painted the wall. Bob slept."), (0, 1, 0, "Bob", "Yesterday it rained.")],
    [(0, 0, 1, "Bob", "Marta met Rex."), (1, 7, 0, "Cy", "Another scope.")],
    [(0, 0, 0, "Ann", "Marta painted the door."), (0, 2, 0, "Ann", "Last words?")],
]


def known(upto):
    last = {}
    for rows in BATCHES[: upto + 1]:
        last |= {r[:3]: (*r, DAY) for r in rows}
    return sorted(last.values())


def test_store_grows_with_a_stream_and_remembers(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame([(*r, DAY) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest(stream, path, str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None and versions(spark, path) == list(range(n + 1))
    add_turns(spark.createDataFrame([(*r, DAY) for r in BATCHES[2]], SCHEMA), path, 2)  # the last batch runs again
    for n in range(3):
        assert sorted(map(tuple, turns_at(spark, path, n).select("scope", "episode", "turn", "speaker", "text", "said_on").collect())) == known(n)
        at_once = run_steps(spark, STORE, {"turn_": spark.createDataFrame(known(n), SCHEMA)}, {"c": "SELECT * FROM component"})["c"]
        pick = ["scope", "episode", "turn", "pos", "text", "subject", "predicate", "object_", "event_time", "nth_", "component_id"]
        assert sorted(map(tuple, components_at(spark, path, n).select(pick).collect())) == sorted(map(tuple, at_once.select(pick).collect()))
    assert components_at(spark, path, 0).where("text LIKE '%Rex%' OR text LIKE '%door%'").count() == 0
    with pytest.raises(Exception):
        turns_at(spark, str(tmp_path / "nothing"), 0).count()
