"""Predictions judged against answers, and the scores of whole benchmarks, overall and by group.

Columns of predictions and answers are texts; a null counts as empty. ``scores`` reads
its rows once: groupings are expanded before one aggregation with partial sums. The mean
over no rows is null, so a benchmark without rows gives one row with n = 0.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.asked import fields, stripped, text_of

# Words that say yes, and words that carry no answer (the second list is left out of longer answers as well).
YES = ("yes", "true", "correct", "是", "对的")
EMPTY_WORDS = "the a an is are was were be been being have has had do does did will would should could may might must can".split()
MORE_EMPTY = "this that these those in on at to for of with by".split()


def plain(text: Column) -> Column:
    return F.lower(stripped(text_of(text)))


def exact(predicted: Column, answer: Column) -> Column:
    return (plain(predicted) == plain(answer)).cast("double")


def partial(predicted: Column, answer: Column) -> Column:
    """1 where equal, 0.5 where one text holds the other (an empty one is held by all), else 0."""
    p, a = plain(predicted), plain(answer)
    return F.when(p == a, 1.0).when(F.contains(p, a) | F.contains(a, p), 0.5).otherwise(0.0)


def overlap(predicted: Column, answer: Column) -> Column:
    """Share of the answer's distinct words that the prediction holds; 0 without words."""
    p, a = fields(F.lower(text_of(predicted))), F.array_distinct(fields(F.lower(text_of(answer))))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(p, a)) / F.size(a)).otherwise(0.0)


def word_f1(predicted: Column, answer: Column) -> Column:
    """F1 of distinct words; null where the answer has none, so that means leave such rows out."""
    p, a = (F.array_distinct(fields(F.lower(text_of(c)))) for c in (predicted, answer))
    return F.when(F.size(a) > 0, 2.0 * F.size(F.array_intersect(p, a)) / (F.size(p) + F.size(a)))


def correct(predicted: Column, answer: Column, kind: Column) -> Column:
    """Whether a document question of kind yes_no, short_answer or another is answered."""
    p, a = plain(predicted), plain(answer)
    says_yes = F.greatest(*(F.contains(p, F.lit(w)) for w in YES))
    numbers = F.size(F.array_intersect(F.regexp_extract_all(p, F.lit(r"\p{Nd}+"), F.lit(0)), F.regexp_extract_all(a, F.lit(r"\p{Nd}+"), F.lit(0)))) > 0
    told = lambda text, empty: F.filter(F.array_distinct(fields(text)), lambda w: ~w.isin(*empty))

    def share(empty):
        words = told(a, empty)
        return F.when(F.size(words) > 0, F.size(F.array_intersect(told(p, empty), words)) / F.size(words)).otherwise(0.0)

    return (
        F.when(text_of(predicted).isin("") | p.isin("", "0"), False)
        .when(F.contains(p, a) | F.contains(a, p), True)
        .when((F.coalesce(kind, F.lit("")) == "yes_no") | a.isin("yes", "no"), says_yes == (a == "yes"))
        .when(kind == "short_answer", numbers | (share(EMPTY_WORDS) > 0.3))
        .otherwise(share(EMPTY_WORDS + MORE_EMPTY) > 0.2)
    )


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the distinct relevant ids among the first ``k`` retrieved; null where none is relevant."""
    wanted = F.array_distinct(relevant)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), wanted)) / F.size(wanted))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    first = F.array_min(F.transform(F.array_intersect(retrieved, relevant), lambda x: F.array_position(retrieved, x)))
    return F.coalesce(1 / F.when(first > 0, first), F.lit(0.0))


def scores(rows: DataFrame, metrics: dict[str, Column], by: dict[str, Column], many: dict[str, Column] | None = None) -> DataFrame:
    """(grouping, value, n, one column per metric): means over all rows and over each group; ``many`` are groupings by each element of an array."""
    def named(name, value):
        return F.struct(F.lit(name).alias("grouping"), value.alias("value"))

    def elements(name, values):
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: named(name, v))

    groups = [F.array(named("all", F.lit("")), *(named(name, F.coalesce(value, F.lit("unknown"))) for name, value in by.items())), *(elements(name, values) for name, values in (many or {}).items())]
    each = rows.select(*(m.alias(f"m_{k}") for k, m in enumerate(metrics.values())), F.explode(F.concat(*groups)).alias("g"))
    grouped = each.groupBy("g.grouping", "g.value").agg(F.count("*").alias("n"), *(F.round(F.avg(f"m_{k}"), 9).alias(name) for k, name in enumerate(metrics)))
    nothing = rows.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("all").alias("grouping"), F.lit("").alias("value"), "n", *(F.lit(None).cast("double").alias(name) for name in metrics))
    return grouped.union(nothing)


def keyword_search(entries: DataFrame, words: list[str], k: int = 5, scope=(), keywords: str = "keywords", text: str = "text", order: str = "id") -> DataFrame:
    """The ``k`` best entries of each scope with their ``score``: two points for a word among the entry's keywords, one for a word in its text."""
    listed = F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), F.lower)
    low = F.lower(text_of(F.col(text)))
    points = sum((2 * F.coalesce(F.array_contains(listed, w.lower()), F.lit(False)).cast("int") + F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    # Scopes may be few and large: the best of each part of the rows come first.
    scored = entries.withColumn("score", points).where("score > 0").withColumn("part_", F.pmod(F.xxhash64(order), F.lit(64)))
    for by in ([*scope, "part_"], list(scope)):
        scored = scored.withColumn("rnk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), order))).where(F.col("rnk") <= k)
    return scored.drop("part_")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the answers after them; the kind of a question is dealt by its conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("answer"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predicted"))
    return asked.join(said, ["conv_id", "turn"]).withColumn("kind", F.expr("CASE conv_id % 3 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'short_answer' ELSE 'abstractive' END"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: the label as the answer, what their length suggests as the prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return labels.join(docs, "doc_id").withColumns({"answer": F.expr("CASE quality WHEN 1 THEN 'Keep' WHEN 0 THEN 'drop' END"), "predicted": F.expr("CASE WHEN n_chars >= 2000 THEN ' keep' WHEN n_chars >= 400 THEN 'keep it' ELSE 'DROP ' END")})


def turn_verdicts(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", "kind", correct(F.col("predicted"), F.col("answer"), F.col("kind")).alias("correct"))


def choice_scores(spark, sf_dir):
    rows = choices(spark, sf_dir)
    return scores(rows, {"accuracy": exact(F.col("predicted"), F.col("answer"))}, {"subject": F.col("lang"), "grade": F.col("source")})


def dialogue_scores(spark, sf_dir):
    p, a = F.col("predicted"), F.col("answer")
    return scores(pairs(spark, sf_dir), {"f1": word_f1(p, a), "accuracy": partial(p, a), "overlap": overlap(p, a)}, {"category": F.col("kind")})


def visual_scores(spark, sf_dir):
    p, a = F.col("predicted"), F.col("answer")
    size = F.when(F.col("n_chars") < 1000, "easy").otherwise("hard")
    return scores(choices(spark, sf_dir), {"accuracy": partial(p, a), "f1": word_f1(p, a), "exact": exact(p, a)}, {"task": F.col("source"), "difficulty": size})


def document_scores(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("ok", correct(F.col("predicted"), F.col("answer"), F.col("kind")).cast("double"))
    return scores(rows, {"accuracy": F.col("ok")}, {"kind": F.col("kind"), "domain": F.expr("CAST(conv_id % 4 AS string)")})


def paged_scores(spark, sf_dir):
    rows = choices(spark, sf_dir)
    pages = F.expr("CASE WHEN toxic = 1 THEN 'unanswerable' WHEN n_chars >= 3000 THEN 'cross_page' ELSE 'single_page' END")
    sources = F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 1000, F.lit("long"))))
    return scores(rows, {"accuracy": exact(F.col("predicted"), F.col("answer"))}, {"pages": pages, "doc_type": F.col("lang")}, {"evidence": sources})


def ranked_parts(spark, sf_dir) -> DataFrame:
    """For each supplier its parts by quantity, and the part that earned most as the relevant one."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("earned"))
    lists = sold.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("q")).alias("q"), "l_partkey"))).alias("s"), F.min(F.struct((-F.col("earned")).alias("earned"), "l_partkey"))["l_partkey"].alias("best"))
    return lists.select("l_suppkey", F.col("s.l_partkey").alias("retrieved"), F.array("best").alias("relevant"))


def retrieval_scores(spark, sf_dir):
    got, want = F.col("retrieved"), F.col("relevant")
    metrics = {f"r_at_{k}": recall_at(got, want, k) for k in (1, 5, 10)} | {"mrr": reciprocal_rank(got, want)}
    return scores(ranked_parts(spark, sf_dir), metrics, {})


def turn_recalls(spark, sf_dir):
    """Longest turns of a conversation as retrieved, the assistant's as relevant."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("n"), "turn"))).alias("s"), F.collect_set(F.when(F.col("role") == "assistant", F.col("turn"))).alias("relevant"))
    return scores(lists, {f"recall_{k}": recall_at(F.col("s.turn"), F.col("relevant"), k) for k in (1, 5, 10)}, {}).drop("grouping", "value")


def keyword_hits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", F.array("lang", "source").alias("keywords"))
    return keyword_search(docs, ["EN", "web", "that", "und", "ción"], 5, ["source"], order="doc_id").select("source", "doc_id", "score", "rnk")


_PLAIN = "lower(trim(coalesce({}, ''), ' ' || chr(10) || chr(9) || chr(13)))"
_PAIR = f"pair AS (SELECT u.conv_id, u.turn, {_PLAIN.format('u.text')} AS a, {_PLAIN.format('s.text')} AS p, CASE u.conv_id % 3 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'short_answer' ELSE 'abstractive' END AS kind FROM conversations u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 AND s.role = 'assistant' WHERE u.role = 'user')"


def _told(text, empty):
    return f"list_distinct(list_filter(string_split_regex({text}, '\\s+'), lambda w: w NOT IN ({', '.join(repr(w) for w in ['', *empty])})))"


def _share(empty):
    return f"coalesce(len(list_intersect({_told('p', empty)}, {_told('a', empty)}))::double / nullif(len({_told('a', empty)}), 0), 0)"


_CORRECT = f"CASE WHEN p IN ('', '0') THEN false WHEN contains(p, a) OR contains(a, p) THEN true WHEN kind = 'yes_no' OR a IN ('yes', 'no') THEN regexp_matches(p, '{'|'.join(YES)}') = (a = 'yes') WHEN kind = 'short_answer' THEN len(list_intersect(regexp_extract_all(p, '[0-9]+'), regexp_extract_all(a, '[0-9]+'))) > 0 OR {_share(EMPTY_WORDS)} > 0.3 ELSE {_share(EMPTY_WORDS + MORE_EMPTY)} > 0.2 END"
_CHOICE = "c AS (SELECT lang, source, n_chars, toxic, CASE quality WHEN 1 THEN 'keep' WHEN 0 THEN 'drop' ELSE '' END AS a, CASE WHEN n_chars >= 2000 THEN 'keep' WHEN n_chars >= 400 THEN 'keep it' ELSE 'drop' END AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id), s AS (SELECT *, CAST(p = a AS int)::double AS x, CASE WHEN p = a THEN 1.0e0 WHEN contains(p, a) OR contains(a, p) THEN 0.5e0 ELSE 0e0 END AS half FROM c)"
_SET_F1 = f"CASE WHEN len({_told('a', [])}) > 0 THEN 2e0 * len(list_intersect({_told('p', [])}, {_told('a', [])})) / (len({_told('p', [])}) + len({_told('a', [])})) END"


def _groups(rows, means, by, where="TRUE"):
    return " UNION ALL ".join(f"SELECT '{g}' AS grouping, {v} AS value, count(*) AS n, {means} FROM {rows} WHERE {where} GROUP BY ALL" if v != "''" else f"SELECT 'all' AS grouping, '' AS value, count(*) AS n, {means} FROM {rows}" for g, v in {"all": "''", **by}.items())


ORACLES = {
    "o332_document_verdicts": f"WITH {_PAIR} SELECT conv_id, turn, kind, {_CORRECT} AS correct FROM pair",
    "o179_choice_scores": f"WITH {_CHOICE} {_groups('s', 'round(avg(x), 9) AS accuracy', {'subject': 'lang', 'grade': 'source'})}",
    "o180_dialogue_scores": f"WITH {_PAIR}, s AS (SELECT kind, {_SET_F1} AS f, CASE WHEN p = a THEN 1e0 WHEN contains(p, a) OR contains(a, p) THEN 0.5e0 ELSE 0e0 END AS half, {_share([])} AS o FROM pair) {_groups('s', 'round(avg(f), 9) AS f1, round(avg(half), 9) AS accuracy, round(avg(o), 9) AS overlap', {'category': 'kind'})}",
    "o182_visual_scores": f"WITH {_CHOICE}, v AS (SELECT *, {_SET_F1} AS f FROM s) {_groups('v', 'round(avg(half), 9) AS accuracy, round(avg(f), 9) AS f1, round(avg(x), 9) AS exact', {'task': 'source', 'difficulty': '''CASE WHEN n_chars < 1000 THEN 'easy' ELSE 'hard' END'''})}",
    "o183_document_scores": f"WITH {_PAIR}, s AS (SELECT kind, conv_id % 4 AS d, CAST({_CORRECT} AS int)::double AS ok FROM pair) {_groups('s', 'round(avg(ok), 9) AS accuracy', {'kind': 'kind', 'domain': 'd::varchar'})}",
    "o184_paged_scores": f"WITH {_CHOICE}, e AS (SELECT unnest(list_filter([lang, source, CASE WHEN n_chars > 1000 THEN 'long' END], lambda v: v IS NOT NULL)) AS v, x FROM s) {_groups('s', 'round(avg(x), 9) AS accuracy', {'pages': '''CASE WHEN toxic = 1 THEN 'unanswerable' WHEN n_chars >= 3000 THEN 'cross_page' ELSE 'single_page' END''', 'doc_type': 'lang'})} UNION ALL SELECT 'evidence', v, count(*), round(avg(x), 9) FROM e GROUP BY v",
    "o181_retrieval_scores": "WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, sum(l_extendedprice::decimal(18,2)) AS e FROM lineitem GROUP BY ALL), r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rnk, row_number() OVER (PARTITION BY l_suppkey ORDER BY e DESC, l_partkey) AS nth FROM s) SELECT 'all' AS grouping, '' AS value, count(*) AS n, round(avg(CASE WHEN rnk <= 1 THEN 1e0 ELSE 0 END), 9) AS r_at_1, round(avg(CASE WHEN rnk <= 5 THEN 1e0 ELSE 0 END), 9) AS r_at_5, round(avg(CASE WHEN rnk <= 10 THEN 1e0 ELSE 0 END), 9) AS r_at_10, round(avg(1e0 / rnk), 9) AS mrr FROM r WHERE nth = 1",
    "o174_recall_at_k": "WITH r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(length(text), 0) DESC, turn) AS rnk FROM conversations), c AS (SELECT conv_id, nullif(count(CASE WHEN role = 'assistant' THEN 1 END), 0) AS rel, count(CASE WHEN role = 'assistant' AND rnk <= 1 THEN 1 END) AS a, count(CASE WHEN role = 'assistant' AND rnk <= 5 THEN 1 END) AS b, count(CASE WHEN role = 'assistant' AND rnk <= 10 THEN 1 END) AS c FROM r GROUP BY conv_id) SELECT count(*) AS n, round(avg(a::double / rel), 9) AS recall_1, round(avg(b::double / rel), 9) AS recall_5, round(avg(c::double / rel), 9) AS recall_10 FROM c",
    "o223_keyword_hits": "WITH s AS (SELECT source, doc_id, CAST(" + " + ".join(f"CASE WHEN lower(lang) = '{w}' OR lower(source) = '{w}' THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN 1 ELSE 0 END" for w in ("en", "web", "that", "und", "ción")) + " AS int) AS score FROM documents) SELECT source, doc_id, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS int) AS rnk FROM s WHERE score > 0 QUALIFY rnk <= 5",
}
QUERIES = []
BUILT = {
    name: (build, ORACLES[name])
    for name, build in {
        "o332_document_verdicts": turn_verdicts, "o179_choice_scores": choice_scores, "o180_dialogue_scores": dialogue_scores, "o182_visual_scores": visual_scores, "o183_document_scores": document_scores,
        "o184_paged_scores": paged_scores, "o181_retrieval_scores": retrieval_scores, "o174_recall_at_k": turn_recalls, "o223_keyword_hits": keyword_hits,
    }.items()
}
