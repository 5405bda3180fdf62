"""Ordered folds in batch and over streams, against plain loops."""

import collections
import glob
import math
import os
import random
import time

import pytest

from turnloom.streaming.folds import EntropyGate, RedundancyGate, WindowBuffer, fold_stream, fold_table


@pytest.fixture(scope="module")
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def gate_loop(vectors, window, high=0.9, low=0.7):
    """Decisions for one sequence, written on its own: the kept items are indices."""
    kept, out = [], []
    for i, v in enumerate(vectors):
        if v is None:
            out.append("ACCEPT")
            continue
        cos = [sum(a * b for a, b in zip(v, vectors[k])) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(a * a for a in vectors[k])) for k in kept[-window:]]
        if cos and max(cos) > high:
            out.append("REJECT")
        elif cos and sum(cos) / len(cos) >= low:
            out.append("UNCERTAIN")
        else:
            kept.append(i)
            out.append("ACCEPT")
    return out


def sequences(seed, n=120):
    rng = random.Random(seed)
    point, out = [1.0, 0.0, 0.0], []
    for _ in range(n):
        point = [x + rng.gauss(0, 0.35) for x in point]
        out.append(None if rng.random() < 0.03 else point)
    return out


@pytest.mark.parametrize("window", [1, 5])
def test_entropy_gates(spark, window):
    talks = {k: sequences(k) for k in range(5)} | {None: sequences(99, 20)}
    rows = [(k, i, v) for k, vs in talks.items() for i, v in enumerate(vs)] + [(1, None, [1.0, 0.0, 0.0])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key spans many batches
    try:
        got = fold_table(spark.createDataFrame(rows, "k long, i long, vector array<double>").repartition(3), "k", "i", EntropyGate(window)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_key = collections.defaultdict(dict)
    for r in got:
        by_key[r.k][r.i] = r.decision
    assert {k: [d[i] for i in sorted(d)] for k, d in by_key.items()} == {k: gate_loop(vs, window) for k, vs in talks.items()}
    assert len({x for d in by_key.values() for x in d.values()}) == 3


def test_redundancy_gate(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.sample("red blue green white black grey brown pink".split(), rng.randint(1, 6))) for _ in range(200)] + [None, "", "short", "   ", "x" * 900 + " tail"]
    recent, want = [], []
    for t in texts:
        t = t or ""
        if len(t.strip()) < 10:
            want.append("SHORT")
            continue
        mine = set(t.split())
        top = max([len(mine & set(r.split())) / len(mine | set(r.split())) for r in recent[-50:]], default=0)
        want.append("REJECT" if top > 0.8 else "UNCERTAIN" if top > 0.5 else "ACCEPT")
        if top <= 0.8:
            recent.append(t[:200])
    got = fold_table(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "k long, i long, text string"), "k", "i", RedundancyGate()).orderBy("i").collect()
    assert [r.decision for r in got] == want and set(want) == {"SHORT", "REJECT", "UNCERTAIN", "ACCEPT"}


def windows_of(items, size, overlap):
    out, rest, stride = [], list(items), max(1, size - overlap)
    while len(rest) >= size:
        out.append((rest[:size], False))
        rest = rest[stride:]
    return out + ([(rest, True)] if rest else [])


@pytest.mark.parametrize("size,overlap", [(4, 0), (4, 1), (3, 2), (1, 0), (2, 5), (40, 2)])
def test_window_buffers(spark, size, overlap):
    lengths = {0: 1, 1: size, 2: size - 1 or 1, 3: 3 * size + 1, 4: 25}
    rows = [(k, i, 100 * k + i) for k, n in lengths.items() for i in range(n)]
    got = collections.defaultdict(list)
    for r in fold_table(spark.createDataFrame(rows, "k long, i long, item long"), "k", "i", WindowBuffer(size, overlap)).orderBy("k", "window_no").collect():
        got[r.k].append((r.items, r.flushed))
    assert got == {k: windows_of([100 * k + i for i in range(n)], size, overlap) for k, n in lengths.items()}
    assert fold_table(spark.createDataFrame([], "k long, i long, item long"), "k", "i", WindowBuffer(2)).count() == 0


def run(spark, source, sink, checkpoint, schema, fold):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = fold_stream(stream, "k", "i", fold).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("fold,schema", [(EntropyGate(5), "k long, i long, vector array<double>"), (WindowBuffer(4, 1), "k long, i long, item long")])
def test_stream_equals_table_across_a_restart(stateful, tmp_path, fold, schema):
    """Three files arrive, the query ends and starts again from its checkpoint before the third; late rows are left out."""
    spark = stateful
    rows = [(k, i, v if "vector" in schema else i) for k in range(3) for i, v in enumerate(sequences(k, 30))]
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n, (low, high) in enumerate([(0, 11), (11, 20), (20, 30)]):
        part = [r for r in rows if low <= r[1] < high] + ([(0, 3, rows[3][2]), (1, 10, rows[10][2])] if n == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        if n:
            run(spark, source, sink, checkpoint, schema, fold)
    table = fold_table(spark.createDataFrame(rows, schema), "k", "i", fold)
    if "flushed" in table.columns:
        table = table.where("NOT flushed")
    plain = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect()), key=repr)
    assert plain(spark.read.parquet(sink)) == plain(table)


def test_idle_keys_are_flushed(stateful, tmp_path):
    spark = stateful
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, i, i) for i in range(6)] + [(1, 0, 7)], "k long, i long, item long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k long, i long, item long").parquet(source)
    query = fold_stream(stream, "k", "i", WindowBuffer(4, 1), idle_ms=500).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            done = spark.read.parquet(sink).where("flushed").count() if glob.glob(os.path.join(sink, "*.parquet")) and glob.glob(os.path.join(sink, "_spark_metadata", "*")) else 0
            if done == 2:
                break
    finally:
        query.stop()
    got = sorted((r.k, r.window_no, r.items, r.flushed) for r in spark.read.parquet(sink).collect())
    assert got == [(0, 0, [0, 1, 2, 3], False), (0, 1, [3, 4, 5], True), (1, 0, [7], True)]
