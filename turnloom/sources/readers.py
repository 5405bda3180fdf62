"""Readers of dialogue files, lines of JSON and tables of text, each with the schema it declares.

Sessions of a dialogue file are keys ``session_<n>`` of one object, so that object is read
as a map of texts and each session is parsed once its key has been taken apart.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "sample_id string, source_dataset string, language string, split string, conversation map<string,string>, qa array<struct<question:string,category:int,evidence:array<string>,answer:string,adversarial_answer:string>>"
TURN = "array<struct<speaker:string,dia_id:string,text:string>>"


def dialogue_files(spark: SparkSession, paths) -> DataFrame:
    """One row per sample of JSON files that hold a sample or an array of samples; columns that a file lacks are null."""
    return spark.read.schema(SAMPLES).option("multiLine", True).json(paths)


def turns(samples: DataFrame) -> DataFrame:
    """One row per turn: sample_id, session_num, turn_index (from 1), dia_id, speaker, text, session_date. Keys order by number."""
    entry = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    session = entry.where(number != "").select("sample_id", number.cast("int").alias("session_num"), F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("session_date"), F.from_json("value", TURN).alias("said"))
    row = session.select("sample_id", "session_num", "session_date", F.posexplode("said").alias("pos", "t"))
    return row.select("sample_id", "session_num", (F.col("pos") + 1).alias("turn_index"), "t.dia_id", "t.speaker", "t.text", "session_date")


def questions(samples: DataFrame) -> DataFrame:
    """One row per question: sample_id, qa_idx (from 0) and its fields."""
    return samples.select("sample_id", F.posexplode("qa").alias("qa_idx", "q")).select("sample_id", "qa_idx", "q.*")


def json_lines(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Rows of JSON-lines files; blank lines give none, a line that is no object gives nulls and itself in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("ignoreMissingFiles", True).json(paths)


def tab_separated(spark: SparkSession, paths, columns: list[str]) -> DataFrame:
    """Rows of tab-separated files with a header line, every value a text."""
    return spark.read.csv(paths, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def last_by_key(df: DataFrame, key: str, place: Column) -> DataFrame:
    """The row of each key that comes last by ``place``; rows with a null key form one group."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(place.desc()))
    return df.withColumn("_back", back).where("_back = 1").drop("_back")


def script_turns(lines: DataFrame, source: str, place: str, line: str) -> DataFrame:
    """Turns of a script: a line ``name: words`` opens a turn, others carry it on; title lines and blank ones fall away.

    Returns source, turn_index (from 1), speaker, text. Lines before the first turn fall away.
    """
    text = F.trim(F.col(line))
    kept = lines.where((text != "") & ~text.rlike("^(Teleplay|Story)")).select(source, place, text.alias("_line"), (F.instr(text, ":") > 1).alias("_opens"))
    so_far = Window.partitionBy(source).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = kept.withColumn("turn_index", F.sum(F.col("_opens").cast("int")).over(so_far)).where("turn_index > 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "_line"))), lambda s: s["_line"]), " ")
    one = grouped.groupBy(source, "turn_index").agg(whole.alias("_all"))
    at = F.instr("_all", ":")
    return one.select(source, "turn_index", F.trim(F.substring(F.col("_all"), F.lit(1), at - 1)).alias("speaker"), F.trim(F.substring(F.col("_all"), at + 1, F.length("_all"))).alias("text"))
