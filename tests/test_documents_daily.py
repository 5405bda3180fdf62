"""JSON helpers, longest common subsequences and the daily store, against plain Python and known places."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import documents
from turnloom.sources import daily

ENTRIES = [{"a": 1}, {"b": "brace } in \\\" text {", "c": {"d": [1, {"e": "]"}]}}, {"f": "é\\n\\\\"}, {}]


def test_salvage_at_every_place(spark):
    whole = '{"note": "x [ y", "entries": [' + ", ".join(json.dumps(e) for e in ENTRIES) + "]}"
    ends, at = [], whole.index('"entries"')
    for e in ENTRIES:
        at = whole.index(json.dumps(e), at) + len(json.dumps(e))
        ends.append(at)
    rows = [(n, whole[:n]) for n in range(len(whole) + 1)] + [(9000, None), (9001, '{"entries": [{bad}, {"ok": 1}]}'), (9002, "no array"), (9003, '[{"x": 1}, 3, {"y"')]
    got = {r.n: r.s for r in spark.createDataFrame(rows, "n long, text string").select("n", documents.salvaged(F.col("text")).alias("s")).collect()}
    start = whole.index('"entries"') + len('"entries": [')
    for n in range(start, len(whole) + 1):
        want = [json.dumps(e, ensure_ascii=False) for e, end in zip(ENTRIES, ends) if end <= n]
        assert got[n] == (want or None), n
    assert got[9000] is got[9002] is None and got[9001] == ['{"ok": 1}'] and got[9003] == ['{"x": 1}']


def test_first_objects(spark):
    rows = [(1, 'so {"a": {"b": "}"}} then {"c": 1}'), (2, "none"), (3, '{"cut": 1'), (4, "{not json}"), (5, None), (6, '\\{"a": 1}')]
    got = {r.n: r.o for r in spark.createDataFrame(rows, "n long, text string").select("n", documents.first_json_object(F.col("text")).alias("o")).collect()}
    assert got == {1: '{"a": {"b": "}"}}', 2: None, 3: None, 4: None, 5: None, 6: '{"a": 1}'}


def test_first_differences(spark):
    rows = [
        (1, {"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}, ("$.a[1].b", "value")), (2, {"a": 1}, {"a": 1}, None), (3, {"a": 1}, {"a": 1.0}, ("$.a", "type")), (4, {"a": 1}, {"b": 1}, ("$", "keys")), (5, [1, 2], [1], ("$", "length")), (6, {"z": 1, "b": [True]}, {"z": 2, "b": [False]}, ("$.b[0]", "value")), (7, None, {}, ("$", "type")),
    ]
    table = [(n, json.dumps(x), json.dumps(y)) for n, x, y, _ in rows] + [(8, "{", "{}"), (9, None, "{}")]
    got = {r.n: r.d and tuple(r.d) for r in spark.createDataFrame(table, "n long, x string, y string").select("n", documents.json_difference(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == {n: d for n, _, _, d in rows} | {8: ("$", "not json"), 9: ("$", "not json")}


def test_secrets_in_leaves(spark):
    value = {"k": ["sk-" + "a" * 24, 5, None, {"deep": "Bearer abc.def"}], "password": "kept as a key"}
    rows = [(1, json.dumps(value)), (2, '{"a": "plain"}'), (3, "no json"), (4, None)]
    got = {r.n: tuple(r.c) for r in spark.createDataFrame(rows, "n long, t string").select("n", documents.redacted_leaves(F.col("t")).alias("c")).collect()}
    assert json.loads(got[1][0]) == {"k": ["[REDACTED_API_KEY]", 5, None, {"deep": "Bearer [REDACTED]"}], "password": "kept as a key"} and got[1][1] == "partial"
    assert got[2] == ('{"a": "plain"}', "none") and got[3] == got[4] == (None, "none")


def table_lcs(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_rouge_l(spark):
    rng = random.Random(6)
    rows = [(n, [rng.choice("abcde") for _ in range(rng.randint(0, 90))], [rng.choice("abcdef") for _ in range(rng.randint(0, 90))]) for n in range(200)] + [(900, None, ["a"]), (901, [], []), (902, ["日", "本"], ["本", "日", "本"]), (903, [f"w{k}" for k in range(20000)], [f"w{k}" for k in range(0, 20000, 2)])]
    got = {r.n: r.v for r in spark.createDataFrame(rows, "n long, x array<string>, y array<string>").select("n", documents.rouge_l(F.col("x"), F.col("y")).alias("v")).collect()}
    for n, x, y in rows[:-1]:
        shared = table_lcs(x or [], y or [])
        assert got[n] == pytest.approx(2 * shared / (len(x) + len(y)) if x and y else 0.0)
    assert got[903] == pytest.approx(2 * 10000 / 30000)


def at(text):
    return int(datetime.datetime.fromisoformat(text + "+00:00").timestamp())


def test_daily_store(spark, tmp_path):
    path = str(tmp_path / "units")
    schema = "id long, ts long, text string, status string, archive_reason string, archived_at long"
    rows = [(k, at("2024-01-30T12:00:00") + k * 6 * 3600, f"t{k}", "PINNED" if k == 9 else "ACTIVE", None, None) for k in range(16)] + [(99, None, "timeless", "ACTIVE", None, None)]
    units = spark.createDataFrame(rows, schema)
    daily.append(units.where("id < 8"), path)
    daily.append(units.where("id >= 8"), path)
    store = daily.opened(spark, path)
    assert store.count() == 17 and {r["day"] for r in store.select("day").distinct().collect()} == {"none", *(f"2024-01-{d}" for d in (30, 31)), *(f"2024-02-0{d}" for d in (1, 2, 3))}
    found = daily.between(store, at("2024-01-31T18:00:00"), at("2024-02-01T06:00:00"))
    assert sorted(r["id"] for r in found.collect()) == [5, 6, 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ">= 2024-01-31" in plan
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "units").rglob("part-*.parquet")}
    before = files()
    assert daily.rewrite(spark, path, F.col("id") == 6, {"text": F.lit("new")}) == 1
    changed = {f.parent.name for f in before.keys() ^ files().keys()}
    assert changed == {"day=2024-02-01"} and daily.opened(spark, path).where("text = 'new'").count() == 1 and daily.opened(spark, path).count() == 17
    assert daily.archive(spark, path, F.col("id").isin(8, 9), "old", 5) == 1
    assert [(r["id"], r["archive_reason"], r["archived_at"]) for r in daily.opened(spark, path).where("status = 'ARCHIVED'").collect()] == [(8, "old", 5)]
    assert daily.rewrite(spark, path, F.col("id").isin(0, 1), None) == 2 and daily.rewrite(spark, path, F.col("id") == 12345, None) == 0
    assert daily.rewrite(spark, path, F.col("id") == 15, {"ts": F.lit(at("2024-02-01T01:00:00"))}) == 1
    rows_now = {r["id"]: r["day"] for r in daily.opened(spark, path).collect()}
    assert len(rows_now) == 15 and rows_now[15] == "2024-02-01" and rows_now[5] == "2024-01-31"
    daily.export(daily.opened(spark, path), str(tmp_path / "out"))
    (tmp_path / "out" / "more.json").write_text("not an object\n\n")
    daily.load(spark, str(tmp_path / "out"), str(tmp_path / "copy"), schema)
    columns = ["id", "ts", "text", "status", "day"]
    assert sorted(map(tuple, daily.opened(spark, str(tmp_path / "copy")).select(columns).collect()), key=repr) == sorted(map(tuple, daily.opened(spark, path).select(columns).collect()), key=repr)


def test_rouge_l_turns_few_rows_at_a_time_into_python_strings(spark):
    run = documents.rouge_l(F.col("x"), F.col("y"))
    rows = [(["a"] * (i % 5), ["a", "b"]) for i in range(300)]
    got = spark.createDataFrame(rows, "x array<string>, y array<string>").select(run.alias("v")).collect()
    assert [r.v for r in got] == [2 * min(1, len(x)) / (len(x) + 2) if x else 0.0 for x, _ in rows]
    assert 0 < documents.SLICE <= 256
