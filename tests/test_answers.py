"""Answers cut into tokens and scored, against plain Python on rows that tell the rules apart."""

import collections
import hashlib
import math
import re
import string
import unicodedata

import pytest

from turnloom.registry import QUERIES

ANSWERS = [
    ("the-cat sat", "The cat, sat!"), (None, "x"), ("", ""), ("a an the", "the"), ("我爱北京 trip the", "北京 ok trip"), ("go go go stop", "go stop"), ("theatre the theatre", "and then a theatre"), ("the the the the end", "end"),
    ("O'Brien's house", "o brien s house"), ("it's", "its"), ("and so on, and on", "so on on"), ("全角！标点 a", "全角标点"), ("thin space　wide", "space wide"), ("“the” end", "end"), ("the_end an_x", "end x"), ("한국어 말", "한국말"),
    ("1,000 cats", "1000 cats"), ("café theé", "café"), ("pick (A)", "(a) it is"), ("(B) or (D)", "(E)"), ("the€ price", "price"), ("'quoted' '", "quoted '"),
]


def metric(text):
    text = re.sub(r"\b(a|an|the)\b", " ", "".join(" " if c in string.punctuation else c for c in (text or "").lower()))
    chars = re.findall("[㐀-鿿぀-ヿ가-힯]", text)
    return chars + re.findall("[a-z0-9]+", text) if chars else text.split()


def answer(text):
    text = "".join(" " if c in string.punctuation or unicodedata.category(c)[0] == "P" else c for c in (text or "").lower())
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", text).split())


def stripped(text):
    text = re.sub(r"\b(a|an|the|and)\b", " ", (text or "").replace(",", "").lower())
    return " ".join("".join(c for c in text if c not in string.punctuation).split())


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("answers"))
    rows = [(k, t, r, x) for k, pair in enumerate(ANSWERS) for t, r, x in ((0, "user", pair[0]), (1, "assistant", pair[1]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    texts = list(dict.fromkeys(x for pair in ANSWERS for x in pair))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    names = ("o272_normalised_answer", "o277_metric_tokens", "o278_set_f1", "o280_bag_f1", "o281_one_option", "o283_bleu1", "o286_normalised_answer")
    return texts, {name: [r.asDict() for r in QUERIES[name](spark, folder).collect()] for name in names}


def test_normalised_answers(got):
    for name, rule in (("o272_normalised_answer", answer), ("o286_normalised_answer", stripped)):
        assert {(r["conv_id"], r["turn"]): r["answer"] for r in got[1][name]} == {(k, t): rule(x) for k, pair in enumerate(ANSWERS) for t, x in enumerate(pair)}


def test_tokens_and_options_of_documents(got):
    texts, rows = got
    assert {r["doc_id"]: (r["n"], r["tokens_sha"]) for r in rows["o277_metric_tokens"]} == {k: (len(metric(x)), hashlib.sha256(" ".join(metric(x)).encode()).hexdigest()) for k, x in enumerate(texts)}
    found = {k: [c for c in "ABCDE" if f"({c})" in (x or "").upper()] for k, x in enumerate(texts)}
    assert {r["doc_id"]: r["picked_option"] for r in rows["o281_one_option"]} == {k: "none" if not f else f[0] if len(f) == 1 else "ambiguous" for k, f in found.items()}


def test_scores_of_answers(got):
    sets, bags, bleus = ({r["conv_id"]: r for r in got[1][n]} for n in ("o278_set_f1", "o280_bag_f1", "o283_bleu1"))
    for k, pair in enumerate(ANSWERS):
        g, s = (set(metric(x)) for x in pair)
        assert math.isclose(sets[k]["f1"], 2 * len(g & s) / (len(g) + len(s)) if g and s else 0, abs_tol=1e-9)
        g, s = (re.findall("[a-z0-9']+", (x or "").lower()) for x in pair)
        m = sum((collections.Counter(g) & collections.Counter(s)).values())
        assert bags[k]["shared"] == m
        assert math.isclose(bags[k]["f1"], 1 if not g and not s else 2 * m / (len(g) + len(s)) if m else 0, abs_tol=1e-9)
        assert math.isclose(bleus[k]["bleu1"], m / len(s) * (1 if len(s) > len(g) else 2.718281828 ** (1 - len(g) / len(s))) if m else 0, abs_tol=1e-8)
