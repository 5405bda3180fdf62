"""Folds over ordered rows whose next step depends on earlier decisions, in batch and over a stream.

A fold keeps a small state per key. ``fold_table`` deals a table's rows by key, sorts
them in the tasks and passes rows through the state, so a task holds one batch of rows
and one state however many rows a key has. ``fold_stream`` does the same with keyed
state in the state store: rows of a micro-batch are taken in order; a row that does not
come after the last one taken for its key is late and left out. At the end of a key's
rows a table's fold is flushed; a stream's is flushed once the key has been idle.

A fold is a class with ``output`` (its columns), ``start()``, ``step(state, row)``, which
changes the state and gives output rows, and ``flush(state)``. States are JSON values.
Null keys are a key of their own in a table; rows without an order take no part.
"""

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Similarity above which an item repeats, and below which it is new; items kept for comparison; texts and characters remembered.
HIGH, LOW, RECENT_ITEMS, RECENT_TEXTS, HEAD, LEAST = 0.9, 0.7, 5, 50, 200, 10


class EntropyGate:
    """Accepts an item that differs from the last accepted ones; ``window`` of them (1: the last alone).

    The first item is accepted. Above ``high`` for any kept item: REJECT. Below ``low`` (the
    mean over the kept): ACCEPT, and the item is kept. Else UNCERTAIN. An item without a
    vector is accepted and not kept.
    """

    output = "decision string, similarity double, kept long"

    def __init__(self, window: int = 1, high: float = HIGH, low: float = LOW):
        self.window, self.high, self.low = window, high, low

    def start(self):
        return {"kept": []}

    def step(self, state, row):
        kept, vector = state["kept"], row["vector"]
        if vector is None:
            return [("ACCEPT", None, len(kept))]
        norm = sum(x * x for x in vector) ** 0.5 + 1e-8
        vector = [x / norm for x in vector]
        similar = [sum(x * y for x, y in zip(vector, other)) for other in kept]
        mean = sum(similar) / len(similar) if similar else None
        if mean is None or (max(similar) <= self.high and mean < self.low):
            kept.append(vector)
            del kept[: -self.window]
            return [("ACCEPT", mean, len(kept))]
        return [("REJECT" if max(similar) > self.high else "UNCERTAIN", mean, len(kept))]

    def flush(self, state):
        return []


class RedundancyGate:
    """Judges a text by its word overlap with the texts let through before it, the last RECENT_TEXTS of them."""

    output = "decision string, overlap double"

    def start(self):
        return {"recent": []}

    def step(self, state, row):
        text = row["text"] or ""
        if len(text.strip()) < LEAST:
            return [("SHORT", None)]
        words, most = set(text.lower().split()), 0.0
        for other in map(set, state["recent"]):
            if other:
                most = max(most, len(words & other) / len(words | other))
        if most > 0.8:
            return [("REJECT", most)]
        state["recent"].append(sorted(set(text[:HEAD].lower().split())))
        del state["recent"][:-RECENT_TEXTS]
        return [("UNCERTAIN" if most > 0.5 else "ACCEPT", most)]

    def flush(self, state):
        return []


class WindowBuffer:
    """Windows of ``size`` items, each repeating the last ``overlap`` of the one before; what is buffered at the end is a window too."""

    output = "window_no long, items array<long>, flushed boolean"

    def __init__(self, size: int, overlap: int = 0):
        self.size, self.stride = size, max(1, size - overlap)

    def start(self):
        return {"buffer": [], "windows": 0}

    def step(self, state, row):
        state["buffer"].append(row["item"])
        if len(state["buffer"]) < self.size:
            return []
        out = [(state["windows"], list(state["buffer"]), False)]
        state["windows"] += 1
        del state["buffer"][: self.stride]
        return out

    def flush(self, state):
        if not state["buffer"]:
            return []
        out = [(state["windows"], state["buffer"], True)]
        state["buffer"], state["windows"] = [], state["windows"] + 1
        return out


def result_schema(df: DataFrame, key: str, order: str, fold) -> StructType:
    given = StructType([df.schema[key], df.schema[order]])
    return StructType(given.fields + StructType.fromDDL(fold.output).fields)


def fold_table(df: DataFrame, key: str, order: str, fold, tie: str | None = None) -> DataFrame:
    """key, order and the fold's columns: one row per output. Rows that share an order are taken by ``tie``."""
    schema = result_schema(df, key, order, fold)
    by = [key, order] + ([tie] if tie else [])

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        current, at, state = None, None, None

        def rows_of(batch):
            nonlocal current, at, state
            for row in batch.to_pylist():
                if state is None or row[key] != current:
                    if state is not None:
                        yield from ((current, at, *x) for x in fold.flush(state))
                    current, state = row[key], fold.start()
                at = row[order]
                yield from ((current, at, *x) for x in fold.step(state, row))

        for batch in batches:
            yield table_of(list(rows_of(batch)), arrow)
        if state is not None:
            yield table_of([(current, at, *x) for x in fold.flush(state)], arrow)

    def table_of(rows, arrow):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return df.where(F.col(order).isNotNull()).repartition(key).sortWithinPartitions(*by).mapInArrow(task, schema)


def fold_stream(df: DataFrame, key: str, order: str, fold, idle_ms: int | None = None) -> DataFrame:
    """The same columns from a stream; needs the state store provider that keeps several states. ``idle_ms``: flush after so long without rows."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    schema = result_schema(df, key, order, fold)
    columns = schema.names

    class Keyed(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("fold", "state string, last string")

        def handleInputRows(self, group, batches, times):
            held = self.state.get() if self.state.exists() else None
            state, last = (json.loads(held[0]), json.loads(held[1])) if held else (fold.start(), None)
            rows = pd.concat(list(batches)).dropna(subset=[order]).sort_values(order, kind="stable")
            out = []
            for row in rows.to_dict("records"):
                if last is None or row[order] > last:
                    last = row[order]
                    row = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()}
                    out += [(group[0], last, *x) for x in fold.step(state, row)]
            last = last.item() if hasattr(last, "item") else last
            self.state.update((json.dumps(state), json.dumps(last)))
            if idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + idle_ms)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.state.get()
            state, last = json.loads(held[0]), json.loads(held[1])
            out = [(key[0], last, *x) for x in fold.flush(state)]
            self.state.update((json.dumps(state), json.dumps(last)))
            yield pd.DataFrame(out, columns=columns)

        def close(self):
            pass

    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=Keyed(), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if idle_ms is not None else "None")


def vectors(spark, sf_dir):
    """Embeddings as the frames of one sequence per label, in the order of their ids."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("label", "vec_id", "embedding AS vector")


def entropy_gate(spark, sf_dir):
    return fold_table(vectors(spark, sf_dir), "label", "vec_id", EntropyGate()).withColumn("similarity", F.round("similarity", 6))


def entropy_gate_of_five(spark, sf_dir):
    return fold_table(vectors(spark, sf_dir), "label", "vec_id", EntropyGate(RECENT_ITEMS)).withColumn("similarity", F.round("similarity", 6))


def redundancy_gate(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return fold_table(turns, "conv_id", "turn", RedundancyGate()).withColumn("overlap", F.round("overlap", 6))


def window_buffer(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id", "turn", "turn AS item")
    out = fold_table(turns, "conv_id", "turn", WindowBuffer(4, 1))
    return out.select("conv_id", "window_no", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "flushed")


QUERIES = []
BUILT = {
    "o376_entropy_gate": (entropy_gate, None),
    "o377_entropy_gate_of_five": (entropy_gate_of_five, None),
    "o375_redundancy_gate": (redundancy_gate, None),
    # Full windows begin every third turn; the rest, from where the next would begin, is flushed.
    "o369_window_buffer": (
        window_buffer,
        """
        WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        w AS (SELECT conv_id, turn, i, n, CASE WHEN n >= 4 THEN (n - 4) // 3 + 1 ELSE 0 END AS complete FROM t),
        full_ AS (SELECT conv_id, k AS window_no, string_agg(CAST(turn AS varchar), ',' ORDER BY i) AS items, false AS flushed FROM (SELECT w.*, unnest(range(complete)) AS k FROM w) x WHERE i BETWEEN 3 * k AND 3 * k + 3 GROUP BY conv_id, k),
        rest AS (SELECT conv_id, complete AS window_no, string_agg(CAST(turn AS varchar), ',' ORDER BY i) AS items, true AS flushed FROM w WHERE i >= 3 * complete GROUP BY conv_id, complete)
        SELECT * FROM full_ UNION ALL SELECT * FROM rest""",
    ),
}
