"""The store that Spark builds for questions: only of scopes that they ask, with the same rows for them."""

import datetime

from turnloom.plans.routing import STEPS
from turnloom.sql import run_steps

DAY = datetime.date(2023, 5, 9)
SAID = ["Ann painted the garden. Bob liked it!", "Marta Lopez visited Paris yesterday; she loved the garden.", "Where did Bob paint?"]
OVER = {n: f"SELECT * FROM {n}" for n in ("component", "edge", "component_term", "turn_line", "pooled", "answer_context")}


def tables(spark, scopes):
    turns = [(s, e, t, "Ann", said, DAY) for s in scopes for e in range(2) for t, said in enumerate(SAID)]
    questions = [(1, 7, "Where did Marta and Bob paint the garden?", "multi_hop"), (2, 9, "When did Ann visit Paris?", "temporal"), (3, 11, "Why?", ""), (4, None, "Who?", "")]
    sources = {
        "turn_": spark.createDataFrame(turns, "scope long, episode long, turn long, speaker string, text string, said_on date"),
        "question_": spark.createDataFrame([(*q, "", "", "", "") for q in questions], "q long, scope long, text string, question_type string, hop_type string, answerability string, dataset string, asker string"),
        "base_": spark.createDataFrame([(1, 0, 1)], "q long, episode long, turn long"),
    }
    return {n: sorted(map(repr, df.collect())) for n, df in run_steps(spark, STEPS, sources, OVER).items()}


def test_scopes_that_nobody_asks_are_not_built(spark):
    few, many = tables(spark, [7, 9]), tables(spark, [None, 3, 7, 8, 9, 10])
    assert all(few.values())
    assert few == many
