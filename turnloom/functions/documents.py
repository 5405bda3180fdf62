"""JSON texts that are cut off, differ or hold secrets; the longest common subsequence of two token lists.

Each function takes columns and gives a column. Rows are worked on in Arrow batches by
small helpers, one row at a time and without state between rows.
"""

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.routes import SECRETS
from turnloom.plans.metrics import PLAIN
from turnloom.sql import render


#: Rows of a batch whose tokens are Python strings at one time.
SLICE = 64


def balanced_end(text: str, start: int) -> int | None:
    """Place after the brace that closes the one at ``start``; braces in strings don't count. None where the text ends before."""
    depth, at, size = 0, start, len(text)
    while at < size:
        c = text[at]
        if c == '"':
            at += 1
            while at < size and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
            if at >= size:
                return None
        elif c == "\\":
            at += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def salvaged_entries(text: str | None) -> list[str] | None:
    """The whole objects of the array ``entries`` (or of the first array), as JSON; None if there is none."""
    if not text:
        return None
    at = text.find("[", max(0, text.find('"entries"')))
    out = []
    while at >= 0:
        at = text.find("{", at)
        end = balanced_end(text, at) if at >= 0 else None
        if end is None:
            break
        try:
            out.append(json.dumps(json.loads(text[at:end]), ensure_ascii=False))
        except json.JSONDecodeError:
            pass
        at = end
    return out or None


def first_object(text: str | None) -> str | None:
    """The first object of a text, as JSON; null where its braces don't close or it is no JSON."""
    at = (text or "").find("{")
    end = balanced_end(text, at) if at >= 0 else None
    try:
        return json.dumps(json.loads(text[at:end]), ensure_ascii=False) if end else None
    except json.JSONDecodeError:
        return None


def first_difference(expected, actual, path="$") -> tuple[str, str] | None:
    """(path, what differs) of the first place where two JSON values differ: keys in order, then elements."""
    if type(expected) is not type(actual):
        return path, "type"
    if isinstance(expected, dict):
        if expected.keys() != actual.keys():
            return path, "keys"
        below = ((expected[k], actual[k], f"{path}.{k}") for k in sorted(expected))
    elif isinstance(expected, list):
        if len(expected) != len(actual):
            return path, "length"
        below = ((x, y, f"{path}[{i}]") for i, (x, y) in enumerate(zip(expected, actual)))
    else:
        return None if expected == actual else (path, "value")
    return next((d for d in (first_difference(*b) for b in below) if d), None)


def parsed(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False, None


def json_difference(expected: Column, actual: Column) -> Column:
    """struct(path, difference) of the first place where two JSON texts differ; null if none; ``not json`` where a text is none."""

    @F.udf("path string, difference string", useArrow=True)
    def run(x, y):
        (ok, a), (fine, b) = parsed(x), parsed(y)
        return first_difference(a, b) if ok and fine else ("$", "not json")

    return run(expected, actual)


def redacted_leaves(payload: Column) -> Column:
    """struct(payload, redaction): a JSON text with secrets in its string leaves replaced; null payload where it is no JSON."""
    patterns = [(re.compile(p), put) for p, put in SECRETS]

    def leaf(value):
        for pattern, put in patterns:
            value = pattern.sub(put, value)
        return value

    def walk(value):
        if isinstance(value, str):
            return leaf(value)
        if isinstance(value, list):
            return [walk(v) for v in value]
        return {k: walk(v) for k, v in value.items()} if isinstance(value, dict) else value

    @F.udf("payload string, redaction string", useArrow=True)
    def run(text):
        ok, value = parsed(text)
        if not ok:
            return None, "none"
        after = walk(value)
        return json.dumps(after), "none" if after == value else "partial"

    return run(payload)


def salvaged(text: Column) -> Column:
    """array<string> of the whole entries of a JSON text that may be cut off."""
    return F.udf(salvaged_entries, "array<string>", useArrow=True)(text)


def first_json_object(text: Column) -> Column:
    return F.udf(first_object, "string", useArrow=True)(text)


def lcs_length(left, right) -> int:
    """Length of the longest common subsequence, one bit per token of ``right``: time in the product of lengths over the word size, space in their sum."""
    places = {}
    for i, t in enumerate(right):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(right)) - 1
    row = full
    for t in left:
        met = row & places.get(t, 0)
        row = ((row + met) | (row - met)) & full
    return len(right) - row.bit_count()


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F measure of the longest common subsequence of two token arrays; 0 where either has no tokens."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for s in range(0, len(x), SLICE):
            for a, b in zip(x.slice(s, SLICE).to_pylist(), y.slice(s, SLICE).to_pylist()):
                out.append(2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0)
        return pa.array(out, pa.float64())

    return run(prediction, reference)


def metric_tokens(column: str) -> Column:
    """The tokens that answers are compared by: no punctuation, no articles, one token per Chinese, Japanese or Korean character."""
    return F.expr(render(PLAIN.replace("$", column), 0))


def turn_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it in its conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", metric_tokens("text").alias("toks"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("toks").alias("earlier"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rouge_l(F.col("toks"), F.col("earlier")), 6).alias("rouge_l"))


def mean_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_rouge(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.avg("rouge_l"), 6).alias("mean_rouge_l"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of events with their secrets replaced, and how each differs from the user's one before."""
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "props")
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("event_id"))
    told = events.withColumns({"clean": redacted_leaves(F.col("props")), "d": json_difference(before, F.col("props"))})
    return told.select("event_id", F.col("clean.payload").alias("payload"), F.col("clean.redaction").alias("redaction"), F.col("d.path").alias("path"), F.col("d.difference").alias("difference"))


QUERIES = []
BUILT = {
    "o276_rouge_l": (turn_rouge, None),
    "o141_mean_rouge_l": (mean_rouge, None),
    "o362_redacted_payloads": (event_payloads, None),
}
