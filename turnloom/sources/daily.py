"""A store of memory units in one folder per day: append, rewrite of the days concerned, reads pruned by day.

Units carry ``id``, ``ts`` (seconds since 1970) and what columns else; ``day`` is derived
from ts in UTC. Rewrites replace the folders of the days that hold a changed unit and no
others. Units without ts lie in a folder of their own and no range of time finds them.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sql import kept

#: Seconds of a day, and the folder of units without a time.
DAY, TIMELESS = 86400, "none"


def with_day(units: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / DAY) * DAY), "yyyy-MM-dd")
    return units.withColumn("day", F.coalesce(day, F.lit(TIMELESS)))


def append(units: DataFrame, path: str) -> None:
    """Add units; one file per day and task at most, so rows are first brought together by day."""
    with_day(units).repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("day").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """All units; the day stays a text, so filters on it prune folders."""
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", before)


def between(units: DataFrame, start, end) -> DataFrame:
    """Units of an opened store with start <= ts <= end: only the folders of these days are read, across ends of months too."""
    days = [F.date_format(F.timestamp_seconds(F.lit(int(x // DAY) * DAY)), "yyyy-MM-dd") for x in (start, end)]
    return units.where(F.col("day").between(*days) & F.col("ts").between(start, end) & (F.col("day") != TIMELESS))


def rewrite(spark: SparkSession, path: str, touched: Column, change: dict[str, Column] | None) -> int:
    """Change columns of the units where ``touched`` holds, or delete these units (``change`` None); returns how many there were.

    The days that hold such units are rewritten whole. A changed ts moves a unit to its
    new day. A day that becomes empty keeps an empty folder.
    """
    units = opened(spark, path)
    hit = kept(units.where(touched).select("id", "day"))
    days = [r["day"] for r in hit.select("day").distinct().collect()]
    if not days:
        return 0
    mine = F.coalesce(touched, F.lit(False))
    rows = units.where(F.col("day").isin(days))
    if change is None:
        after = rows.where(~mine)
    else:
        after = rows.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in change.items()})
    after = kept(with_day(after.drop("day")))
    new_days = [r["day"] for r in after.select("day").distinct().collect()]
    # Units that move into a day outside the rewritten ones join what is there.
    joined = after.unionByName(units.where(F.col("day").isin([d for d in new_days if d not in days])))
    count, emptied = hit.count(), [d for d in days if d not in new_days]
    # The new rows rest in a folder of their own first, so that no task ever reads a folder that is being replaced.
    staging = f"{path.rstrip('/')}__staging/{uuid.uuid4().hex}"
    joined.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.parquet(staging)
    out = spark.read.schema(joined.schema).parquet(staging)
    out.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for d in emptied:
        out.drop("day").limit(0).write.mode("overwrite").parquet(f"{path}/day={d}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return count


def archive(spark: SparkSession, path: str, touched: Column, reason: str, at: int) -> int:
    """Mark units ARCHIVED, but not those that are PINNED."""
    free = touched & (F.coalesce(F.col("status"), F.lit("")) != "PINNED")
    return rewrite(spark, path, free, {"status": F.lit("ARCHIVED"), "archive_reason": F.lit(reason), "archived_at": F.lit(at).cast("long")})


def export(units: DataFrame, path: str) -> None:
    """Lines of JSON, without the folder column."""
    units.drop("day").write.mode("overwrite").json(path)


def load(spark: SparkSession, lines: str, path: str, schema: str) -> None:
    """Append exported lines; a line that is no object is left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(lines)
    append(kept(rows).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), path)
