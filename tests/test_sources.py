"""Readers on files that the tests write."""

import json

from pyspark.sql import functions as F

from turnloom.sources import readers


def sample(name, sessions, qa=()):
    talk = {"speaker_a": "Ann", "speaker_b": "Bo"}
    for n, said in sessions.items():
        talk[f"session_{n}"] = [{"speaker": s, "dia_id": f"D{n}:{k}", "text": t} for k, (s, t) in enumerate(said, 1)]
        talk[f"session_{n}_date_time"] = f"day {n}"
    return {"sample_id": name, "source_dataset": "x", "language": "en", "split": "eval", "conversation": talk, "qa": list(qa)}


def test_turns_of_dialogue_files_order_by_number(spark, tmp_path):
    qa = [{"question": "who?", "category": 1, "evidence": ["D2:1"], "answer": "Bo"}, {"question": "when?", "category": 5, "evidence": [], "adversarial_answer": "never"}]
    (tmp_path / "a.json").write_text(json.dumps([sample("s1", {10: [("Ann", "late")], 2: [("Bo", "früh"), ("Ann", "")]}, qa), sample("s2", {})]))
    (tmp_path / "b.json").write_text(json.dumps(sample("s3", {1: [("Bo", None)]})))
    samples = readers.dialogue_files(spark, str(tmp_path))
    rows = readers.turns(samples).orderBy("sample_id", "session_num", "turn_index").collect()
    assert [tuple(r) for r in rows] == [("s1", 2, 1, "D2:1", "Bo", "früh", "day 2"), ("s1", 2, 2, "D2:2", "Ann", "", "day 2"), ("s1", 10, 1, "D10:1", "Ann", "late", "day 10"), ("s3", 1, 1, "D1:1", "Bo", None, "day 1")]
    asked = readers.questions(samples).orderBy("qa_idx").collect()
    assert [(r.qa_idx, r.question, r.answer, r.adversarial_answer) for r in asked] == [(0, "who?", "Bo", None), (1, "when?", None, "never")]


def test_json_lines_keep_bad_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\nnot json\n{"id": 1, "v": "y"}\n{"v": "z"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, v string").cache()
    assert sorted((r.id, r.v) for r in rows.where("_corrupt_record IS NULL").collect() if r.id) == [(1, "x"), (1, "y")]
    assert [r._corrupt_record for r in rows.where("_corrupt_record IS NOT NULL").collect()] == ["not json"]


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (None, 0, "c"), (2, 0, "d")], "id long, at_ long, v string")
    assert sorted(r.v for r in readers.last_by_key(rows, "id", F.col("at_")).collect()) == ["b", "c", "d"]
    assert readers.last_by_key(rows.limit(0), "id", F.col("at_")).count() == 0


def test_tab_separated_values_stay_texts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n007\tä b\n8\t\n")
    rows = readers.tab_separated(spark, str(tmp_path / "a.tsv"), ["id", "name"]).collect()
    assert [tuple(r) for r in rows] == [("007", "ä b"), ("8", None)]


def test_script_lines_carry_on(spark):
    script = ["Story by X: Y", "lost line", "Ann: hello", "  and more ", "", "Bo : fine: yes"]
    rows = spark.createDataFrame([("e", k, t) for k, t in enumerate(script)], "ep string, pos long, line string")
    got = readers.script_turns(rows, "ep", "pos", "line").orderBy("turn_index").collect()
    assert [(r.turn_index, r.speaker, r.text) for r in got] == [(1, "Ann", "hello and more"), (2, "Bo", "fine: yes")]
