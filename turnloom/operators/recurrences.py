"""Linear recurrences over ordered rows, clamped after each step: running averages, adaptive thresholds, decaying posteriors.

Row by row ``x`` becomes ``min(high, max(low, scale * x + shift))`` (scale >= 0). Such
steps compose to a step of the same form, so the rows of a key need not pass through one
task: rows are range-partitioned by key and order, each partition composes its own steps
into one per key, the few composed steps of each key (one per partition at most) are
chained in order, and every partition then runs from its own start.

Defined cases: a null scale counts as 1, a null shift as 0, null bounds as none. Rows
without an order take no part; rows that share one are taken by ``tie``. A null key is a
key. An empty table gives an empty result. Other columns pass through.
"""

import math
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.sql import kept

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Decay of posteriors of the strategies not chosen, decay of the running averages.
POSTERIOR_DECAY, EMA_DECAY = 0.99, 0.95


def then(first, second):
    """The step that does ``first`` and then ``second``; steps are (scale, shift, low, high)."""
    a, b, low, high = first
    c, d, floor, top = second
    clamp = lambda x: min(top, max(floor, c * x + d)) if math.isfinite(x) else (min(top, max(floor, x)) if c > 0 else min(top, max(floor, d)))
    return a * c, b * c + d, clamp(low), clamp(high)


def _columns(batch, names):
    """The steps (scale, shift, low, high) of a batch as lists, nulls replaced by what they count as."""
    out = []
    for name, default in zip(names, (1.0, 0.0, -math.inf, math.inf)):
        out.append(pc.fill_null(batch.column(name), default).to_numpy(zero_copy_only=False).tolist())
    return out


def _stretches(keys, parts):
    """(key, part, first row, row after the last) of the stretches of rows that share both."""
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first] or parts[i] != parts[first]:
            yield keys[first], parts[first], first, i
            first = i


def composed(step, steps):
    """``step`` followed by all of ``steps`` (see ``then``)."""
    a, b, low, high = step
    for c, d, floor, top in steps:
        a, b = a * c, b * c + d
        if c:
            low, high = c * low + d, c * high + d
        else:
            low = high = d
        low = low if low > floor else floor
        low = low if low < top else top
        high = high if high > floor else floor
        high = high if high < top else top
    return a, b, low, high


def running(df: DataFrame, key: str, order: str, scale, shift, start=0.0, low=None, high=None, tie: str | None = None, out: str = "value") -> DataFrame:
    """``df`` with ``out``, the value after each row's step; ``start`` is the value before the first."""
    return running_all(df, key, order, {out: (scale, shift, start, low, high)}, tie)


def running_all(df: DataFrame, key: str, order: str, recurrences: dict, tie: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``recurrences`` (name: scale, shift, start, low, high), all in one pass over the ordered rows."""
    by, outs, kind = [key, order] + ([tie] if tie else []), list(recurrences), df.schema[key].dataType.simpleString()
    held, added = [[f"_{w}_{n}" for w in ("scale", "shift", "low", "high")] for n in range(len(outs))], {}
    for n, (scale, shift, start, low, high) in enumerate(recurrences.values()):
        added |= dict(zip([*held[n], f"_start_{n}"], (scale, shift, low, high, start)))
    rows = df.where(F.col(order).isNotNull()).withColumns({k: (F.lit(v) if not hasattr(v, "cast") else v).cast("double") for k, v in added.items()})
    # Parts are ranges of rows in order; a part is written once, so both passes below see the same parts.
    dealt = kept(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionById(parts, "_part").sortWithinPartitions("_part", *by)
    steps_of, firsts = [c for names in held for c in names], [f"_start_{n}" for n in range(len(outs))]
    whole_schema = f"key {kind}, part int, " + ", ".join(f"a{n} double, b{n} double, lo{n} double, hi{n} double, first{n} double" for n in range(len(outs)))
    names_of_whole = [part.split()[0] for part in whole_schema.split(", ")]

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(df.schema[key].dataType)

    def compose(batches):
        current, states = None, None
        for batch in batches:
            keys, parts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            steps = [_columns(batch, names) for names in held]
            starts = [batch.column(name) for name in firsts]
            for k, p, i, j in _stretches(keys, parts_):
                if current is None or (k, p) != current:
                    if current is not None:
                        yield emit(current, states)
                    current, states = (k, p), [((1.0, 0.0, -math.inf, math.inf), s[i].as_py()) for s in starts]
                states = [(composed(state, zip(*(c[i:j] for c in own))), first) for (state, first), own in zip(states, steps)]
        if current is not None:
            yield emit(current, states)

    def emit(current, states):
        numbers = [x for state, first in states for x in (*state, first)]
        return pa.RecordBatch.from_arrays([pa.array([current[0]], arrow_key), pa.array([current[1]], pa.int32()), *[pa.array([x], pa.float64()) for x in numbers]], names_of_whole)

    whole = dealt.select(key, "_part", *steps_of, *firsts).mapInArrow(compose, whole_schema)
    # One row per key and partition: chained by an aggregate over the composed steps before each.
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = whole.select(F.col("key").alias("_key"), F.col("part").alias("_at"), *[
        F.aggregate(F.collect_list(F.struct(F.col(f"a{n}").alias("a"), F.col(f"b{n}").alias("b"), F.col(f"lo{n}").alias("lo"), F.col(f"hi{n}").alias("hi"))).over(before), F.first(f"first{n}").over(Window.partitionBy("key").orderBy("part")), lambda x, s: F.least(s["hi"], F.greatest(s["lo"], s["a"] * x + s["b"]))).alias(f"_begin_{n}")
        for n in range(len(outs))
    ])
    names = [*df.columns, *outs]
    schema = dealt.select(*df.columns).withColumns({o: F.lit(0.0) for o in outs}).schema

    def run(batches):
        current, values = None, None
        for batch in batches:
            found = [[] for _ in outs]
            steps = [_columns(batch, own) for own in held]
            for k, p, i, j in _stretches(batch.column(key).to_pylist(), batch.column("_part").to_pylist()):
                if current is None or (k, p) != current:
                    current, values = (k, p), [batch.column(f"_begin_{n}")[i].as_py() for n in range(len(outs))]
                for n, (own, to) in enumerate(zip(steps, found)):
                    value = values[n]
                    for a, b, lo, hi in zip(*(c[i:j] for c in own)):
                        value = a * value + b
                        value = value if value > lo else lo
                        value = value if value < hi else hi
                        to.append(value)
                    values[n] = value
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in df_columns], *[pa.array(v, pa.float64()) for v in found]], names)

    df_columns = df.columns
    met = dealt.join(F.broadcast(begins), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at"))).drop("_key", "_at", *firsts).sortWithinPartitions("_part", *by)
    return met.mapInArrow(run, schema)


def posteriors(outcomes: DataFrame, strategies: DataFrame, kind: str = "kind", order: str = "at", decay: float = POSTERIOR_DECAY) -> DataFrame:
    """kind, strategy, at, alpha, beta after each outcome (kind, at, strategy, success, quality) for every strategy of its kind.

    The chosen strategy's alpha grows by quality on success, its beta by 1 - quality on
    failure; the others decay towards the uniform prior, never below 1. Outcomes of a
    strategy that is not in ``strategies`` (kind, strategy) change nothing.
    """
    known = outcomes.join(strategies.select(kind, "strategy"), [kind, "strategy"], "left_semi")
    arms = known.withColumnRenamed("strategy", "chosen").join(strategies.select(kind, "strategy"), kind).withColumn("_arm", F.concat_ws("\x1f", F.col(kind).cast("string"), "strategy"))
    mine = F.col("chosen") == F.col("strategy")
    scale, low = F.when(mine, 1.0).otherwise(decay), F.when(~mine, 1.0)
    arms = arms.select(kind, "strategy", order, "_arm", scale.alias("_kept"), low.alias("_least"), F.when(mine & F.col("success"), F.col("quality")).otherwise(0.0).alias("_won"), F.when(mine & ~F.col("success"), 1 - F.col("quality")).otherwise(0.0).alias("_lost"))
    both = running_all(arms, "_arm", order, {out: (F.col("_kept"), F.col(grown), 1.0, F.col("_least"), None) for out, grown in (("alpha", "_won"), ("beta", "_lost"))})
    return both.select(kind, "strategy", order, "alpha", "beta")


def smoothed(df: DataFrame, key: str, order: str, value: str, decay: float = EMA_DECAY, start: float = 0.5, out: str = "smoothed") -> DataFrame:
    """Exponential moving average; a row without a value leaves it as it is."""
    seen = F.col(value).isNotNull()
    return running(df, key, order, F.when(seen, decay).otherwise(1.0), F.when(seen, (1 - decay) * F.col(value)).otherwise(0.0), start, out=out)


def adaptive_threshold(df: DataFrame, key: str, order: str, value: str, target: float, rate: float, start: float, low: float, high: float, every: int, warm: int = 0) -> DataFrame:
    """A threshold that moves, every ``every`` rows once ``warm`` rows have passed, by ``rate`` times the gap of the smoothed value to its target, within bounds."""
    average = smoothed(df, key, order, value)
    counted = running(average, key, order, 1.0, 1.0, 0.0, out="seen")
    moves = (F.col("seen") >= warm) & (F.col("seen") % every == 0)
    return running(counted, key, order, 1.0, F.when(moves, rate * (F.col("smoothed") - target)).otherwise(0.0), start, low=F.when(moves, low), high=F.when(moves, high), out="threshold")


def event_posteriors(spark, sf_dir):
    """Users as kinds, event types as strategies; an event of value above 10 is a success of that share of 40."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL")
    outcomes = events.select((F.col("user_id") % 5).alias("kind"), F.col("event_id").alias("at"), F.col("event_type").alias("strategy"), (F.col("value") > 10).alias("success"), F.least(F.lit(1.0), F.coalesce("value", F.lit(0.0)) / 40).alias("quality"))
    strategies = outcomes.select("kind", "strategy").distinct()
    return posteriors(outcomes, strategies).select("kind", "strategy", "at", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def event_thresholds(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", (F.col("value") / 40).alias("value"))
    moved = adaptive_threshold(events, "event_type", "event_id", "value", target=0.7, rate=0.05, start=0.9, low=0.5, high=0.98, every=10, warm=20)
    return moved.select("event_type", "event_id", F.round("smoothed", 6).alias("smoothed"), F.round("threshold", 6).alias("threshold"))


QUERIES = []
BUILT = {"o385_posteriors": (event_posteriors, None), "o383_adaptive_thresholds": (event_thresholds, None)}
