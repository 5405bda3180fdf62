"""What a question asks for: range of time, modality, depth, tags, variants, kind and number of results.

The functions take a column of questions and give a column; ``experiences`` takes
DataFrames. A null question counts as empty. Letters, digits and white space are those of
all scripts, so a word ends where no letter, digit or underscore follows. All of it stays
in built-in expressions; nothing depends on other rows but ``experiences``.
"""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.sql import SPACE

# Phrases of time, in the order they are looked for, and the range that each names: unit and offset.
TIMES = {"yesterday": ("day", -1), "today": ("day", 0), "last week": ("week", -1), "this week": ("week", 0), "last month": ("month", -1), "this month": ("month", 0)}
ISO_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
# What hints at a modality, in order.
MODALITIES = {
    "visual": ("image", "picture", "photo", "look like", "see", "show", "visual"),
    "audio": ("audio", "sound", "hear", "said", "voice", "speech", "listen"),
    "video": ("video", "clip", "recording", "footage"),
    "text": ("text", "written", "document", "note", "message"),
}
# Words that ask for evidence ("everify" is the surveyed spelling), question words, prefixes and words to leave out.
EVIDENCE = ("show me", "prove", "everify", "exactly", "specifically", "details?")
FACTUAL = ("what", "who", "where", "when", "how", "why")
PREFIXES = (*FACTUAL, "show me", "find")
TAG_STOPS = ("the", "and", "for", "with", "that")
COMMON = ("the", "a", "an", "is", "are", "was", "were", "do", "does", "did")
# What marks the kinds of questions, in the order of the kinds.
KINDS = {
    "cross_modal": ("show me", "image", "picture", "video", "audio", "sound", "visual", "look like", "hear", "watch"),
    "temporal": ("when", "before", "after", "during", "yesterday", "last week", "recently", "earlier", "later", "time", "date", "year", "month"),
    "reasoning": ("why", "how", "explain", "because", "reason", "cause", "compare", "difference", "relationship", "implication"),
    "entity_centric": ("who", "where", "which person", "which place"),
}
# Results by category, phrases that ask for lists, and words that are no names.
RESULTS = {"AR": 10, "CD": 15, "VS": 15, "VR": 15, "TR": 20, "FR": 30, "KR": 20, "MR": 25, "TTL": 15}
LISTS = ("list all", "please list", "what are all", "name all", "what were all")
NO_NAMES = """a an the is was were are be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during
before after above below between out off over under again further then once and but or nor not so very just about up down that this these those it its he she they them his
her their my your our what which who whom how when where why if than too also both each all any some such no more most other only same own here there please based conversation
did does user assistant question answer mention mentioned discuss discussed talk talked say said""".split()

BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def text_of(question: Column) -> Column:
    return F.coalesce(question, F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return stripped(F.regexp_replace(text, f"[{SPACE}]+", " "))


def fields(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def holds(text: Column, words) -> Column:
    return F.greatest(*(F.contains(text, F.lit(w)) for w in words), F.lit(False))


def has_word(text: Column, pattern: str) -> Column:
    return text.rlike(BEFORE + f"(?:{pattern})" + AFTER)


def time_range(question: Column, today: Column) -> Column:
    """struct(temporal, first, until): the days that the first phrase of time found means, until exclusive; a date that is none gives no days."""
    low, date = F.lower(text_of(question)), today.cast("date")
    starts = {"day": date, "week": F.date_trunc("week", date).cast("date"), "month": F.trunc(date, "month")}
    days = {"day": 1, "week": 7, "month": 30}
    # Months are told off in steps of thirty days, as surveyed.
    first = {p: F.date_add(starts[unit], offset * days[unit]) for p, (unit, offset) in TIMES.items()}
    until = {p: F.date_add(first[p], days[unit]) for p, (unit, _) in TIMES.items()}
    written = F.regexp_extract(low, BEFORE + ISO_DATE + AFTER, 1)
    day = F.when(~written.startswith("0000"), written.try_cast("date"))
    begin = end = None
    for p in TIMES:
        begin = (begin.when if begin is not None else F.when)(has_word(low, p), first[p])
        end = (end.when if end is not None else F.when)(has_word(low, p), until[p])
    temporal = has_word(low, "|".join(TIMES)) | (written != "")
    return F.struct(temporal.alias("temporal"), begin.otherwise(day).alias("first"), end.otherwise(F.date_add(day, 1)).alias("until"))


def cleaned(question: Column) -> Column:
    """The question without its phrases of time."""
    return collapsed(F.regexp_replace(text_of(question), "(?i)" + BEFORE + "(?:" + "|".join((*TIMES, ISO_DATE)) + ")" + AFTER, ""))


def modality_hints(question: Column) -> Column:
    low = F.lower(text_of(question))
    return F.array_compact(F.array(*(F.when(holds(low, words), F.lit(m)) for m, words in MODALITIES.items())))


def seeks_evidence(question: Column) -> Column:
    return has_word(F.lower(text_of(question)), "|".join(EVIDENCE))


def depth(question: Column) -> Column:
    return F.when(seeks_evidence(question), "evidence").when(F.size(modality_hints(question)) > 0, "details").otherwise("summary")


def factual(question: Column) -> Column:
    return F.lower(text_of(question)).rlike("^(?:" + "|".join(FACTUAL) + ")" + AFTER)


def strategy(question: Column, today: Column) -> Column:
    """struct(k, modality, first, until, expand, depth): how to search for it."""
    hints, when = modality_hints(question), time_range(question, today)
    k = F.when(seeks_evidence(question), 5).when(when["temporal"], 20).otherwise(10)
    return F.struct(k.alias("k"), F.when(F.size(hints) == 1, F.get(hints, F.lit(0))).alias("modality"), when["first"].alias("first"), when["until"].alias("until"), (depth(question) != "summary").alias("expand"), depth(question).alias("depth"))


def tags(question: Column) -> Column:
    """The first five words of more than two letters, without marks."""
    bare = F.transform(fields(F.lower(text_of(question))), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return F.slice(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(*TAG_STOPS)), 1, 5)


def variants(question: Column) -> Column:
    """The question, without its leading question word, and without common words: each once, in that order."""
    text = text_of(question)
    low = F.lower(text)
    rest = F.lit(None).cast("string")
    for p in PREFIXES:
        rest = F.when(low.startswith(p), stripped(F.substring(text, len(p) + 1, 2**31 - 1))).otherwise(rest)
    plain = collapsed(F.regexp_replace(low, BEFORE + "(?:" + "|".join(COMMON) + ")" + AFTER, ""))
    return F.array_distinct(F.array_compact(F.array(text, F.when(rest != "", rest), F.when((plain != "") & (plain != low), plain))))


def features(question: Column) -> Column:
    """struct(kind, names, temporal, complexity, words): complexity is at most 1."""
    text = text_of(question)
    low, words = F.lower(text), fields(text)
    marks = {k: holds(low, v) for k, v in KINDS.items()}
    kind = F.lit("factual")
    for k in reversed(KINDS):
        kind = F.when(marks[k], k).otherwise(kind)
    names = F.size(F.filter(words, lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}.")))
    share = lambda flag, weight: F.when(flag, F.lit(weight)).otherwise(0.0)
    complexity = F.least(F.lit(1.0), 0.2 * (F.size(words) / 30) + share(marks["reasoning"], 0.3) + 0.2 * (names / 5) + share(marks["temporal"], 0.15) + share(marks["cross_modal"], 0.15))
    return F.struct(kind.alias("kind"), names.alias("names"), marks["temporal"].alias("temporal"), complexity.alias("complexity"), F.size(words).alias("words"))


def results_wanted(question: Column, category: Column, k: int = 20) -> Column:
    """How many results to fetch: by category (``k`` for others), more for lists, counts and three or more names."""
    low = F.lower(text_of(question))
    base = F.lit(k)
    for name, n in RESULTS.items():
        base = F.when(category == name, n).otherwise(base)
    names = F.size(F.filter(fields(text_of(question)), lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*NO_NAMES)))
    return F.greatest(base, F.when(holds(low, LISTS), 35), F.when(F.contains(low, F.lit("how many")), 30), F.when(names >= 3, 25))


def experiences(questions: DataFrame, past: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """(id, experience, score, rnk): the ``k`` past questions most like each question.

    ``questions`` has id, kind and complexity; ``past`` has experience, kind, complexity,
    asked (timestamp) and quality. The score is half recency (falling by e every ten days),
    0.3 likeness of complexity and 0.2 quality; ties go to the smaller id. Only past
    questions of the same kind count, or all where none is of that kind.

    Of past questions with one kind and complexity only the best ``k`` can be among the
    best of any question, and questions with one kind and complexity have the same best:
    so both sides shrink to their distinct complexities before they meet.
    """
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("asked")) / 86400e6
    worth = 0.5 * F.exp(-0.1 * days) + 0.2 * F.col("quality")
    known = past.select("experience", "kind", "complexity", worth.alias("worth")).where("worth is not null and complexity is not null")
    best = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = known.withColumn("r", best(["kind", "complexity"], [F.desc("worth"), "experience"])).where(F.col("r") <= k).drop("r")
    asked = questions.select("kind", "complexity").distinct()
    kinds = known.select("kind").distinct()
    own = asked.join(kinds, "kind", "left_semi").join(top.withColumnRenamed("complexity", "c"), "kind")
    of_all = top.withColumn("r", best(["complexity"], [F.desc("worth"), "experience"])).where(F.col("r") <= k).select("experience", F.col("complexity").alias("c"), "worth")
    other = asked.join(kinds, "kind", "left_anti").withColumn("j", F.lit(0)).join(of_all.withColumn("j", F.lit(0)), "j").drop("j")
    met = own.select("kind", "complexity", "experience", "c", "worth").unionByName(other.select("kind", "complexity", "experience", "c", "worth"))
    scored = met.withColumn("score", F.round(F.col("worth") + 0.3 * (1 - F.abs(F.col("c") - F.col("complexity"))), 9))
    ranked = scored.withColumn("rnk", best(["kind", "complexity"], [F.desc("score"), "experience"])).where(F.col("rnk") <= k)
    return questions.select("id", "kind", "complexity").join(ranked, ["kind", "complexity"]).select("id", "experience", "score", "rnk")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


#: Questions without times name one by their number here, so that every rule meets rows: a phrase, a hint and a category.
PHRASES = ["", "yesterday ", "Last week ", "2024-01-0", "show me ", "image and voice ", "How many ", "list all ", "exactly "]
SAID = "concat(element_at(array({}), CAST(1 + (conv_id + turn) % {} AS int)), CASE WHEN (conv_id + turn) % {} = 3 THEN concat(1 + conv_id % 9, ' ') ELSE '' END, text)".format(", ".join(f"'{p}'" for p in PHRASES), len(PHRASES), len(PHRASES))
TODAY = datetime.date(2024, 2, 1)
ID = ("conv_id", "turn")


def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = turns(spark, sf_dir).where("text is not null").select(*ID, F.expr(SAID).alias("q"))
    when = time_range(F.col("q"), F.lit(TODAY))
    return q.select(*ID, when["temporal"].alias("temporal"), when["first"].alias("first_day"), when["until"].alias("until_day"), F.array_join(modality_hints(F.col("q")), ",").alias("hints"), seeks_evidence(F.col("q")).alias("evidence"), factual(F.col("q")).alias("factual"), depth(F.col("q")).alias("depth"), F.sha2(cleaned(F.col("q")), 256).alias("cleaned_sha"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = turns(spark, sf_dir).where("text is not null").select(*ID, strategy(F.expr(SAID), F.lit(TODAY)).alias("s"))
    return q.select(*ID, "s.k", "s.modality", F.col("s.first").alias("first_day"), "s.expand", "s.depth")


def turn_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(*ID, F.array_join(tags(F.col("text")), ",").alias("tags"))


def turn_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = turns(spark, sf_dir).where("text is not null").select(*ID, variants(F.expr(SAID)).alias("v"))
    return v.select(*ID, F.posexplode("v").alias("pos", "variant")).select(*ID, "pos", F.sha2("variant", 256).alias("variant_sha"))


def turn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = turns(spark, sf_dir).select(*ID, features(F.col("text")).alias("f"))
    return f.select(*ID, "f.kind", "f.names", "f.temporal", F.round("f.complexity", 9).alias("complexity"), "f.words")


def turn_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.get(F.array(*(F.lit(c) for c in RESULTS)), F.col("conv_id") % (len(RESULTS) + 1))
    return turns(spark, sf_dir).where("text is not null").select(*ID, results_wanted(F.expr(SAID), category).alias("k"))


def turn_experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn against all of them; a turn was asked on the day of its conversation, and its quality falls with its number."""
    f = turns(spark, sf_dir).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), features(F.col("text")).alias("f"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(conv_id % 30 AS int))").alias("asked"), (1 / (1 + F.col("turn"))).alias("quality"))
    q = f.select("id", "f.kind", F.round("f.complexity", 9).alias("complexity"), "asked", "quality")
    return experiences(q, q.withColumnRenamed("id", "experience"), F.lit(TODAY))


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


# The same rules as text for DuckDB, whose patterns know no look-around: its word boundary tells only ASCII letters, which is
# enough for phrases that the given texts hold only where they are put; articles are cut with their neighbours, twice.
_CUT = r"'(^|[^\pL\pN_])(?:" + "|".join(COMMON) + r")($|[^\pL\pN_])', '\1\2', 'g')"
_PLAIN = f"regexp_replace(regexp_replace(low, {_CUT}, {_CUT}"
_Q = f"q AS (SELECT conv_id, turn, q, lower(q) AS low FROM (SELECT conv_id, turn, list_extract([{_list(PHRASES)}], 1 + (conv_id + turn) % {len(PHRASES)}) || CASE WHEN (conv_id + turn) % {len(PHRASES)} = 3 THEN (1 + conv_id % 9) || ' ' ELSE '' END || text AS q FROM conversations WHERE text IS NOT NULL) x)"
_T = _Q + r""", t AS (SELECT *, regexp_matches(low, '\b(yesterday|today|last week|this week|last month|this month|[0-9]{4}-[0-9]{2}-[0-9]{2})\b') AS temporal,
    CASE WHEN regexp_matches(low, '\byesterday\b') THEN DATE '2024-01-31' WHEN regexp_matches(low, '\blast week\b') THEN DATE '2024-01-22' ELSE try_cast(nullif(regexp_extract(low, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1), '') AS date) END AS first_day,
    CASE WHEN regexp_matches(low, '\blast week\b') THEN 7 ELSE 1 END AS days, regexp_matches(low, '\b(show me|prove|everify|exactly|specifically|details?)\b') AS evidence, """ + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{m}' END" for m, w in MODALITIES.items()) + "], lambda h: h IS NOT NULL), ',') AS hints FROM q)"
_DEPTH = "CASE WHEN evidence THEN 'evidence' WHEN hints <> '' THEN 'details' ELSE 'summary' END"
_FEATURES = "f AS (SELECT *, least(1, 0.2e0 * words / 30 + CASE WHEN reasoning THEN 0.3e0 ELSE 0 END + 0.2e0 * names / 5 + CASE WHEN temporal THEN 0.15e0 ELSE 0 END + CASE WHEN modal THEN 0.15e0 ELSE 0 END) AS complexity, CASE WHEN modal THEN 'cross_modal' WHEN temporal THEN 'temporal' WHEN reasoning THEN 'reasoning' WHEN entity THEN 'entity_centric' ELSE 'factual' END AS kind FROM (SELECT conv_id, turn, role, CAST(len(w) AS int) AS words, CAST(len(list_filter(w[2:], lambda x: regexp_matches(x, '^\\p{Lu}.'))) AS int) AS names, " + ", ".join(f"{_any(KINDS[k])} AS {a}" for k, a in (("cross_modal", "modal"), ("temporal", "temporal"), ("reasoning", "reasoning"), ("entity_centric", "entity"))) + " FROM (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS low, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations) a) b)"
ORACLES = {
    "o297_parsed_queries": f"WITH {_T} SELECT conv_id, turn, temporal, first_day, CAST(first_day + days AS date) AS until_day, hints, evidence, regexp_matches(low, '^({'|'.join(FACTUAL)})\\b') AS factual, {_DEPTH} AS depth, sha256(trim(regexp_replace(regexp_replace(q, '(?i)\\b(yesterday|today|last week|this week|last month|this month|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned_sha FROM t",
    "o300_strategy": f"WITH {_T} SELECT conv_id, turn, CAST(CASE WHEN evidence THEN 5 WHEN temporal THEN 20 ELSE 10 END AS int) AS k, CASE WHEN hints <> '' AND NOT contains(hints, ',') THEN hints END AS modality, first_day, evidence OR hints <> '' AS expand, {_DEPTH} AS depth FROM t",
    "o298_tags": f"SELECT conv_id, turn, array_to_string(list_slice(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({_list(TAG_STOPS)})), 1, 5), ',') AS tags FROM conversations",
    "o299_search_variants": f"WITH {_Q}, v AS (SELECT conv_id, turn, 0 AS place, q AS variant FROM q UNION ALL SELECT conv_id, turn, 1, trim(substr(q, length(regexp_extract(low, '^({'|'.join(PREFIXES)})')) + 1)) FROM q WHERE regexp_matches(low, '^({'|'.join(PREFIXES)})') UNION ALL SELECT conv_id, turn, 2, p FROM (SELECT conv_id, turn, low, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS p FROM q) x WHERE p <> low), d AS (SELECT conv_id, turn, variant, min(place) AS place FROM v WHERE variant <> '' GROUP BY ALL) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) - 1 AS int) AS pos, sha256(variant) AS variant_sha FROM d",
    "o301_query_features": f"WITH {_FEATURES} SELECT conv_id, turn, kind, names, temporal, round(complexity, 9) AS complexity, words FROM f",
    "o295_results_wanted": f"WITH {_Q} SELECT conv_id, turn, greatest(CASE conv_id % {len(RESULTS) + 1} {' '.join(f'WHEN {i} THEN {n}' for i, n in enumerate(RESULTS.values()))} ELSE 20 END, CASE WHEN {_any(LISTS)} THEN 35 ELSE 0 END, CASE WHEN contains(low, 'how many') THEN 30 ELSE 0 END, CASE WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN ({_list(NO_NAMES)}))) >= 3 THEN 25 ELSE 0 END) AS k FROM q",
    "o238_relevant_experiences": f"WITH {_FEATURES}, u AS (SELECT conv_id * 1000 + turn AS id, kind, round(complexity, 9) AS c, 0.5e0 * exp(-0.1e0 * (31 - conv_id % 30)) + 0.2e0 / (1 + turn) AS worth FROM f WHERE role = 'user'), s AS (SELECT a.id, b.id AS experience, round(b.worth + 0.3e0 * (1 - abs(b.c - a.c)), 9) AS score FROM u a JOIN u b ON a.kind = b.kind) SELECT id, experience, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, experience) AS int) AS rnk FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, experience) <= 5",
}
QUERIES = []
BUILT = {
    name: (build, ORACLES[name])
    for name, build in {"o295_results_wanted": turn_results, "o297_parsed_queries": parsed_queries, "o298_tags": turn_tags, "o299_search_variants": turn_variants, "o300_strategy": strategies, "o301_query_features": turn_features, "o238_relevant_experiences": turn_experiences}.items()
}
