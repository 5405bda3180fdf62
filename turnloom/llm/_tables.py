"""Shared-folder tables and other plumbing of the operators."""

import tempfile
import uuid

from pyspark.sql import functions as F


def shared_dir(spark):
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and Spark runs in one JVM, as in tests, is a
    local folder used.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="turnloom-")


def stash(df):
    """Write a table to the shared folder and read it back: its lineage ends there.

    Lost executors cost a reread, not the work before it. All tables of an application
    lie below one folder named after it, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/turnloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column, modulus):
    """Remainder of the CRC-32 of an id written as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def picked(docs, id_col="doc_id", text_col="text", **more):
    """Only the columns an operator needs, under its own names; extra columns can't clash."""
    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    return docs.select(*cols, *[docs[v].alias(k) if isinstance(v, str) else v.alias(k) for k, v in more.items()])


def unused(docs, stem):
    """A column name that the table doesn't have, whatever the case of its letters."""
    names = {c.lower() for c in docs.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


#: A key that more than one row in so many has is joined by broadcast; so that many keys at most.
HOT = 256


def join_unique(rows, table, keys, weight):
    """Inner join of rows with a table that has one row per key, none of them null.

    ``weight`` is the table's column with the number of rows of the key. Keys with more
    than one row in HOT would crowd one task: their rows of the table, HOT at most, are
    broadcast. All others meet in an ordinary shuffle.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = table.where(F.col(weight) * HOT > total)
    light = table.where(F.col(weight) * HOT <= total)
    met = rows.join(F.broadcast(heavy), keys)
    return met.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))
