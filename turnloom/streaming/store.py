"""An evidence store that grows with a stream and can be read as it was after any batch.

Each micro-batch of turns (scope, episode, turn, speaker, text, said_on) is written into
a folder of its own, and with it the components of the episodes that it touches. A batch
that runs again after a failure replaces its own folders. ``turns_at`` and
``components_at`` read the store as of a batch: of a turn that came twice, the last one
then known; of an episode, the components made when it was last touched. So a question
asked after a batch never sees later turns.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.plans.evidence import STORE
from turnloom.sql import run_steps

TURN_KEY = ("scope", "episode", "turn")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The batches that are whole, in order: those whose components have been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/components")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath() for s in files.listStatus(folder)]
    done = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _read(spark: SparkSession, path: str, table: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={b}" for b in batches])


def turns_at(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The turns known after ``batch``, each once, as last written."""
    rows = _read(spark, path, "turns", [b for b in versions(spark, path) if b <= batch])
    last = Window.partitionBy(*TURN_KEY).orderBy(F.desc("batch"), F.desc("text"))
    return rows.withColumn("_back", F.row_number().over(last)).where("_back = 1").drop("_back", "batch")


def components_at(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The components known after ``batch``."""
    rows = _read(spark, path, "components", [b for b in versions(spark, path) if b <= batch])
    newest = rows.groupBy("scope", "episode").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["scope", "episode", "batch"], "left_semi").drop("batch")


def add_turns(turns: DataFrame, path: str, batch: int) -> None:
    """Write a batch of turns, and the components of their episodes anew."""
    spark = turns.sparkSession
    turns.select(*TURN_KEY, "speaker", "text", "said_on").write.mode("overwrite").parquet(f"{path}/turns/batch={batch}")
    mine = _read(spark, path, "turns", [b for b in versions(spark, path) if b < batch] + [batch])
    touched = mine.where(F.col("batch") == batch).select("scope", "episode").distinct()
    last = Window.partitionBy(*TURN_KEY).orderBy(F.desc("batch"), F.desc("text"))
    whole = mine.join(touched, ["scope", "episode"], "left_semi").withColumn("_back", F.row_number().over(last)).where("_back = 1").drop("_back", "batch")
    run_steps(spark, STORE, {"turn_": whole}, {"component": "SELECT * FROM component"})["component"].write.mode("overwrite").parquet(f"{path}/components/batch={batch}")


def ingest(turns: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that adds each micro-batch of a stream of turns to the store."""
    writer = turns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: add_turns(rows, path, batch))
    return (writer.trigger(**trigger) if trigger else writer).start()
