"""Event windows: anchored sessions as an ordered fold, and the same over a stream."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES = []
LENGTH = 1800


def anchored(seconds) -> list[int]:
    """Window numbers: a new window starts once LENGTH seconds have passed since the first event of the open one."""
    out, start, number = [], None, -1
    for s in seconds:
        if start is None or s - start >= LENGTH:
            start, number = s, number + 1
        out.append(number)
    return out


def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each user's events: user_id, window_no, n, first_id, last_id.

    A gap of LENGTH seconds or more always opens a window, so a user's events fall into runs
    that fold on their own. Runs are dealt to tasks and sorted there; a task holds one batch
    of rows and the start of the open window, whatever the length of a run. Events without
    a time take no part; those without a user are one user's.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).where("s IS NOT NULL")
    in_order = Window.partitionBy("user_id").orderBy("s", "event_id")
    gap = F.col("s") - F.lag("s").over(in_order)
    runs = rows.withColumn("opens", F.coalesce((gap >= LENGTH).cast("long"), F.lit(1))).withColumn("run", F.sum("opens").over(in_order)).select("user_id", "run", "s", "event_id")
    dealt = runs.repartition("user_id", "run").sortWithinPartitions("user_id", "run", "s", "event_id")
    opened = dealt.mapInArrow(window_starts, "user_id long, run long, start long, event_id long")
    windows = opened.groupBy("user_id", "run", "start").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("run", "start")).cast("long") - 1
    return windows.select("user_id", number.alias("window_no"), "n", "first_id", "last_id")


def window_starts(batches):
    """Sorted rows with the start of their window in place of their second; what is open passes from batch to batch."""
    key, start = None, 0
    for batch in batches:
        users, runs, seconds = (batch.column(k).to_pylist() for k in range(3))
        out = []
        for u, r, s in zip(users, runs, seconds):
            if (u, r) != key or s - start >= LENGTH:
                key, start = (u, r), s
            out.append(start)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), batch.column(3)], names=["user_id", "run", "start", "event_id"])


def streamed_counts(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts per type and hour of a stream (or table) of events, late rows dropped after ``delay``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "last_id")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


BUILT = {
    "o372_anchored_windows": (anchored_windows, None),
    "x_tumbling_counts": (hourly_counts, "SELECT CAST(epoch(date_trunc('hour', ts)) AS bigint) AS start_s, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2"),
}
