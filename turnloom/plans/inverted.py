"""A stored inverted index with BM25 weights, searched for many questions at once.

``build`` writes three tables below a folder: postings, terms, totals. A term's postings
lie in blocks of similar weight, heaviest first, and a heavy term's blocks are split
further, so no term is one task or one row; each block carries its greatest weight.
``search`` first scores each question on the heaviest block of each of its terms, which
gives a score that its k-th answer reaches at least. A block is then left out if its
greatest weight and those of the question's other terms together stay below that: no
answer can have a posting there, so the answers and their scores are exact.

Weights are those of Okapi BM25: idf = ln(N - df + 0.5) - ln(df + 0.5), and a fraction
(EPSILON) of the mean idf for terms in more than half of the units, where that is
negative. Units that are archived or without tokens take no part; null ids neither. A
question without known terms has no answers; scores of 0 or less are none. Ties go to
smaller ids. Of repeated ids each row is a unit. An empty table gives no answers.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.sql import kept

#: The constants of the ranking.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings of a block, about; buckets of terms that the files are partitioned by.
BLOCK, BUCKETS = 4096, 64
#: Pairs of question and unit that a task of a search may hold, about; tasks of a search at most; pairs of question and block that are broadcast.
PAIRS, PARTS, WIDE = 1 << 19, 4096, 1 << 22


def tokens(text):
    """Runs of two letters or digits or more, lower case."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def counts(units: DataFrame) -> DataFrame:
    """id, size, term, tf of units (id, sorted toks): each row is counted for itself, so nothing is shuffled or held."""
    tok = lambda i: F.get(F.col("toks"), i)
    heads = F.filter(F.sequence(F.lit(0), F.size("toks")), lambda i: (i == 0) | (i == F.size("toks")) | (tok(i) != tok(i - 1)))
    headed = units.withColumn("heads", heads)
    runs = F.zip_with(F.slice("heads", 1, F.size("heads") - 1), F.slice("heads", 2, F.size("heads") - 1), lambda a, b: F.struct(tok(a).alias("term"), (b - a).cast("long").alias("tf")))
    return headed.select("id", F.size("toks").alias("size"), F.inline(runs))


def postings_of(units: DataFrame, id_col: str = "id", text_col: str = "text", status_col: str | None = "status") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, terms, totals) of the units."""
    live = units if status_col is None else units.where(F.coalesce(F.col(status_col), F.lit("")) != "ARCHIVED")
    # Dealt before the texts are cut: a table of few row groups is few tasks otherwise.
    told = kept(live.where(F.col(id_col).isNotNull()).select(id_col, text_col).repartition(id_col).select(F.col(id_col).cast("long").alias("id"), F.sort_array(tokens(F.col(text_col))).alias("toks")).where(F.size("toks") > 0))
    counted = kept(counts(told))
    totals = kept(told.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("mean_size")))
    df = counted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))
    raw = kept(df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = kept(raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf")))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    weighed = counted.crossJoin(F.broadcast(totals)).select("id", "term", part.alias("part")).withColumn("level", F.floor(4 * F.log2((K1 + 1) / F.col("part"))).cast("int"))
    spread = weighed.groupBy("term", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("splits"))
    # Only levels of more than one block need a join; they are few and each is a block's worth of postings or more.
    wide = spread.where("splits > 1")
    split = F.coalesce(F.pmod(F.xxhash64("id"), F.col("splits")), F.lit(0)).cast("int")
    placed = weighed.join(wide, ["term", "level"], "left").withColumn("split", split)
    blocks = placed.groupBy("term", "level", "split").agg(F.max("part").alias("top"), F.collect_list(F.struct("id", "part")).alias("postings"))
    return blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), terms, totals


def build(units: DataFrame, path: str, **columns) -> None:
    """Write the index below ``path``; an index that is there is replaced."""
    blocks, terms, totals = postings_of(units, **columns)
    blocks.repartition("bucket", "term", "level", "split").sortWithinPartitions("term", "level").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "totals"))


def search(index: tuple[DataFrame, DataFrame, DataFrame], questions: DataFrame, k: int = 10, id_col: str = "q", text_col: str = "text") -> DataFrame:
    """q, id, score, rnk: the k best units of each question."""
    blocks, terms, totals = index
    asked = questions.select(F.col(id_col).alias("q"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    wanted = asked.join(terms, "term").select("q", "term", (F.col("times") * F.col("idf")).alias("factor"), F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    wanted = kept(wanted)
    parts = int(totals.crossJoin(wanted.select("q").distinct().agg(F.count("*").alias("asked"))).select(F.least(F.greatest(F.ceil(F.col("n") * F.col("asked") / PAIRS), F.lit(1)), F.lit(PARTS)).alias("parts")).first()["parts"])
    heads = kept(wanted.join(blocks.select("bucket", "term", "level", "split", "top"), ["bucket", "term"]).withColumn("most", F.col("factor") * F.col("top")))
    by_term = Window.partitionBy("q", "term").orderBy(F.desc("most"), "level", "split")
    first = heads.withColumn("nth", F.row_number().over(by_term)).where("nth = 1").select("q", "bucket", "term", "level", "split", "factor")
    bounds = kept(heads.groupBy("q", "term").agg(F.max("most").alias("most")).groupBy("q").agg(F.sum("most").alias("all"), F.min("most").alias("least")))
    reached = scores(first, blocks, parts).withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") == k).select("q", F.col("score").alias("floor"))
    term_most = heads.groupBy("q", "term").agg(F.max("most").alias("term_most"))
    # A sum of negative weights bounds nothing, so such a question keeps all its blocks.
    lowest = F.when(F.col("least") > 0, F.coalesce(F.col("floor"), F.lit(float("-inf")))).otherwise(F.lit(float("-inf")))
    open_ = heads.join(term_most, ["q", "term"]).join(bounds, "q").join(reached, "q", "left").where(F.col("most") + F.col("all") - F.col("term_most") >= lowest - 1e-9)
    ranked = scores(open_.select("q", "bucket", "term", "level", "split", "factor"), blocks, parts).where("score > 0")
    return ranked.withColumn("score", F.round("score", 6)).withColumn("rnk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rnk") <= k)


def scores(chosen: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """q, id, score over the chosen blocks (q, bucket, term, level, split, factor).

    Postings are dealt by their unit before they meet the questions, so the pairs of a task, which grow
    much faster than the postings, are summed and ranked where they arise.
    """
    chosen, key = kept(chosen), ["bucket", "term", "level", "split"]
    met = blocks.join(chosen.select(key).distinct(), key, "left_semi").select(*key, F.explode("postings").alias("p")).select(*key, "p.id", "p.part").repartition(parts, "id")
    askers = chosen.groupBy(key).agg(F.collect_list(F.struct("q", "factor")).alias("askers"))
    askers = F.broadcast(askers) if chosen.count() <= WIDE else askers
    return met.join(askers, key).select("id", "part", F.inline("askers")).groupBy("q", "id").agg(F.sum(F.col("factor") * F.col("part")).alias("score"))


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units; what the system says is archived."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.when(F.col("role") == "system", "ARCHIVED").otherwise("ACTIVE").alias("status"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, terms, _ = postings_of(units_of(spark, sf_dir))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, terms, totals = postings_of(units_of(spark, sf_dir))
    return search((kept(blocks), terms, totals), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, "item_id")


UNITS = r"""
    u AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) >= 2) AS toks FROM conversations WHERE role IS NULL OR role <> 'system'),
    v AS (SELECT id, toks, len(toks) AS size FROM u WHERE len(toks) > 0),
    c AS (SELECT id, size, term, count(*) AS tf FROM (SELECT id, size, unnest(toks) AS term FROM v) x GROUP BY id, size, term),
    s AS (SELECT count(*) AS n, avg(size) AS mean_size FROM v),
    r AS (SELECT term, count(*) AS df, ln(max(s.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM c CROSS JOIN s GROUP BY term),
    i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""
QUERIES = []
BUILT = {
    "o224_index_terms": (index_terms, f"WITH {UNITS} SELECT term, df, round(idf, 6) AS idf FROM i"),
    "o225_index_search": (
        index_search,
        f"""
        WITH {UNITS},
        a AS (SELECT q, term, count(*) AS times FROM (SELECT item_id AS q, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) >= 2)) AS term FROM benchmark) x GROUP BY q, term),
        h AS (SELECT a.q, c.id, round(sum(a.times * i.idf * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * c.size / s.mean_size))), 6) AS score FROM a JOIN i USING (term) JOIN c USING (term) CROSS JOIN s GROUP BY a.q, c.id)
        SELECT q, id, score, rnk FROM (SELECT h.*, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rnk FROM h WHERE score > 0) z WHERE rnk <= 10""",
    ),
}
