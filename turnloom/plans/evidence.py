"""An evidence store over conversations: sentences as components, typed edges between near ones, lexical search over both.

``STORE`` are the steps that make the store of ``turn_`` (scope, episode, turn, speaker,
text, said_on): a scope is one long memory, an episode a session in it. Components are
numbered within their episode; two get an edge in each direction if, once some turn has
been read, both are among the last eight. Question terms meet texts on equal words and,
for the substring bonus, on the first five letters of a term among the five-letter pieces
of a word, so no product of questions and texts is built.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.sql import Plan, Query, Step, kept, render

#: Rows that a task of a ranking scores, about; pairs of question term and word that are broadcast at once.
ROWS, MEETS = 1 << 12, 1 << 18

# Words without content, and the words that mark a relation.
STOP = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'had', 'has', 'have', 'he', 'her', 'him', 'his', 'i', 'in', 'is', 'it', 'its', 'me', 'my', 'of', 'on', 'or', 'our', 'she', 'so', 'that', 'the', 'their', 'them', 'they', 'this', 'to', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'with', 'you', 'your'"
TEMPORAL = "'after', 'before', 'earlier', 'later', 'then', 'today', 'tomorrow', 'tonight', 'yesterday', 'last', 'next', 'ago', 'date', 'time', 'first', 'second', 'finally'"
CAUSAL = "'because', 'since', 'so', 'therefore', 'caused', 'reason', 'why'"
PREFERENCE = "'like', 'love', 'hate', 'prefer', 'favorite', 'want', 'need', 'wish'"
SOCIAL = "'friend', 'mother', 'father', 'brother', 'sister', 'boss', 'wife', 'husband', 'date'"
# Expressions of time in the order in which they are looked for, and the days by which they move a date.
TIMES = ("yesterday", "tomorrow", "tonight", "today", "last week", "next week", "last month", "next month", "last night", "this morning", "this afternoon", "this evening")
DAYS = {"yesterday": -1, "last night": -1, "tomorrow": 1, "today": 0, "tonight": 0, "last week": -7, "next week": 7, "last month": -30, "next month": 30}

CONTENT = f"length(tok) > 2 AND tok NOT IN ({STOP})"
SPACE = "chr(32)"


def content(text: str) -> str:
    """The content words of a text, repeats included."""
    return f"{{content({{tokens({text})}};{STOP})}}"


def marked(words: str) -> str:
    return f"{{size({{among(toks;{words})}})}} > 0"


SENTENCES = f"replace(replace(replace(replace(trim({{squeeze(coalesce(text, ''))}}), '.' || {SPACE}, '.' || chr(30)), '!' || {SPACE}, '!' || chr(30)), '?' || {SPACE}, '?' || chr(30)), chr(59) || {SPACE}, chr(30))"
TIME_EXPR = "CASE " + " ".join(f"WHEN {{inside(low;'{t}')}} THEN '{t}'" for t in TIMES) + " ELSE coalesce(nullif({got_weekday(low)}, ''), {got_clock(low)}) END"
EVENT_TIME = "coalesce(CASE time_expr " + " ".join(f"WHEN '{t}' THEN {{iso({{date_plus(said_on;{d})}})}}" for t, d in DAYS.items()) + " END, '')"
SEARCHED = "concat_ws(' ', subject, predicate, object_, time_expr, event_time)"

#: A scope holds twenty conversations; a conversation's date stands for the date that its session would bear.
TURN = Step("turn_", "SELECT CAST(floor(conv_id / 20.0) AS bigint) AS scope, conv_id AS episode, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text, {date_plus(DATE '2023-01-01';conv_id % 3650)} AS said_on FROM conversations")

STORE = (
    Step("sentence", f"SELECT scope, episode, turn, speaker, said_on, pos, trim(tok) AS text FROM (SELECT scope, episode, turn, speaker, said_on, {{cut({SENTENCES})}} AS parts FROM turn_) l {{posexplode(parts)}} WHERE trim(tok) <> ''"),
    Step("parsed", f"SELECT sentence.*, lower({{blank_letter_beyond_ascii(text)}}) AS low, {{tokens(text)}} AS words, {{without({{tokens(text)}};{STOP})}} AS toks, {{ending({{tokens(text)}};ed;ing)}} AS verbs, {{named({{all_entity({{blank_letter_beyond_ascii(text)}})}};{STOP})}} AS names_ FROM sentence"),
    Step(
        "timed",
        f"""SELECT scope, episode, turn, pos, speaker, said_on, text, coalesce({{nth(names_;1)}}, speaker) AS subject, coalesce({{nth(verbs;1)}}, {{nth(toks;1)}}, '') AS predicate,
            coalesce({{nth({{differing(names_;{{nth(names_;1)}})}};1)}}, '') AS object_, {TIME_EXPR} AS time_expr,
            CASE WHEN {marked(TEMPORAL)} THEN 'temporal' WHEN {marked(CAUSAL)} THEN 'causal' WHEN {marked(PREFERENCE)} THEN 'preference/attribute' WHEN {marked(SOCIAL)} THEN 'social'
                 WHEN {{size({{distinct(names_)}})}} >= 2 THEN 'entity' ELSE 'event-update' END AS relation
        FROM parsed""",
    ),
    Step(
        "component",
        f"""SELECT scope, episode, turn, pos, speaker, said_on, text, subject, predicate, object_, time_expr, relation, {EVENT_TIME} AS event_time,
            'component_' || substr({{sha1('D' || episode || ':' || turn || '||' || pos || '||' || text)}}, 1, 12) AS component_id,
            row_number() OVER (PARTITION BY scope, episode ORDER BY turn, pos) AS nth_,
            count(*) OVER (PARTITION BY scope, episode ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM timed""",
        keep=True,
    ),
    # Pairs at most seven apart share a block of eight or lie in neighbouring ones, so a long episode is never joined with itself whole.
    Step("blocked", "SELECT scope, episode, nth_, upto, CAST(floor(nth_ / 8.0) AS bigint) AS blk FROM component"),
    Step("facing", "SELECT scope, episode, nth_, blk AS at_ FROM blocked UNION ALL SELECT scope, episode, nth_, blk + 1 AS at_ FROM blocked"),
    Step("pair", "SELECT a.scope, a.episode, a.nth_ AS x, b.nth_ AS y, b.upto AS made FROM facing a JOIN blocked b ON a.scope = b.scope AND a.episode = b.episode AND a.at_ = b.blk WHERE a.nth_ < b.nth_ AND b.upto - a.nth_ <= 7"),
    # The state after each turn: of a component's own turn, the first two others among the last eight become its sources.
    Step("state", "SELECT DISTINCT scope, episode, upto FROM component WHERE upto >= 2"),
    Step("turn_span", "SELECT scope, episode, turn, min(nth_) AS head, max(nth_) AS tail FROM component GROUP BY scope, episode, turn"),
    Step("later", "SELECT scope, episode, turn, nth_, place FROM component {upto(upto;nth_ + 7)}"),
    Step("seen", "SELECT l.scope, l.episode, l.nth_, greatest(t.head, l.place - 7) AS head, t.tail, min(l.place) AS made FROM later l JOIN state s ON s.scope = l.scope AND s.episode = l.episode AND s.upto = l.place JOIN turn_span t ON t.scope = l.scope AND t.episode = l.episode AND t.turn = l.turn GROUP BY l.scope, l.episode, l.nth_, greatest(t.head, l.place - 7), t.tail"),
    Step("source_pair", "SELECT scope, episode, nth_ AS l, place AS r, min(made) AS made FROM (SELECT scope, episode, nth_, tail, made, place, CASE WHEN nth_ <= head + 1 THEN head + 2 ELSE head + 1 END AS final FROM seen {upto(head;head + 2)}) x WHERE place <> nth_ AND place <= tail AND place <= final GROUP BY scope, episode, nth_, place"),
    Step("both_ways", "SELECT scope, episode, x AS l, y AS r, made, 0 AS source FROM pair UNION ALL SELECT scope, episode, y AS l, x AS r, made, 0 AS source FROM pair UNION ALL SELECT scope, episode, l, r, made, 1 AS source FROM source_pair"),
    Step(
        "edge",
        """SELECT e.scope, e.episode, e.l, e.r, e.made, e.source,
            CASE WHEN e.source = 1 THEN 'same raw turn source' ELSE coalesce(nullif(a.subject, ''), a.predicate) || ' -> ' || coalesce(nullif(b.subject, ''), b.predicate) END AS relation_text,
            CASE WHEN e.source = 1 THEN 'source_of'
                 WHEN a.subject <> '' AND lower(a.subject) = lower(b.subject) AND a.object_ <> '' AND b.object_ <> '' AND lower(a.object_) <> lower(b.object_) AND a.predicate <> '' AND a.predicate = b.predicate THEN 'conflict_with'
                 WHEN a.time_expr <> '' OR b.time_expr <> '' THEN 'temporal_near'
                 WHEN (a.subject <> '' AND lower(a.subject) IN (lower(b.subject), lower(b.object_))) OR (a.object_ <> '' AND lower(a.object_) IN (lower(b.subject), lower(b.object_))) THEN 'same_entity'
                 WHEN a.relation IN ('causal', 'preference/attribute', 'social', 'event-update') THEN a.relation ELSE 'same_session' END AS edge_type
        FROM both_ways e JOIN component a ON a.scope = e.scope AND a.episode = e.episode AND a.nth_ = e.l JOIN component b ON b.scope = e.scope AND b.episode = e.episode AND b.nth_ = e.r""",
        keep=True,
    ),
)
EPISODE = """
    line AS (SELECT conv_id, turn, role, concat(role, ': ', coalesce(text, '')) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up_, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down_, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    kept AS (SELECT conv_id, up_ AS at_, shown FROM line WHERE up_ <= 3 UNION ALL SELECT conv_id, up_ + 10 AS at_, shown FROM line WHERE n > 3 AND down_ <= 3 UNION ALL SELECT conv_id, 5 AS at_, '...' AS shown FROM line WHERE n > 6 AND up_ = 1),
    episode AS (SELECT conv_id, {joined({collect(shown;at_)}; )} || ' ' || {joined({collect(role;at_)}; )} AS summary FROM (SELECT k.conv_id, k.shown, k.at_, CASE WHEN k.at_ = 1 THEN p.roles ELSE '' END AS role FROM kept k JOIN (SELECT conv_id, {joined({sorted({distinct({collect(role;turn)})})}; )} AS roles FROM conversations GROUP BY conv_id) p ON p.conv_id = k.conv_id) e GROUP BY conv_id)"""


def scored(rows: str, key: str) -> str:
    """``score``: every item of ``benchmark`` against the rows (key, text) that share a term with it or hold one."""
    on = [k.strip() for k in key.split(",")]
    r_key = ", ".join(f"r.{k}" for k in on)
    return f"""
    row_ AS ({rows}),
    rt AS (SELECT {key}, tok, count(*) AS n FROM (SELECT {key}, tok FROM row_ {{explode({{tokens(text)}})}}) x WHERE {CONTENT} GROUP BY {key}, tok),
    asked AS (SELECT item_id, tok, count(*) AS n FROM (SELECT item_id, tok FROM benchmark {{explode({{tokens(text)}})}}) y WHERE {CONTENT} GROUP BY item_id, tok),
    total AS (SELECT item_id, sum(n) AS n FROM asked GROUP BY item_id),
    term AS (SELECT DISTINCT tok FROM asked WHERE length(tok) >= 5),
    word AS (SELECT DISTINCT tok FROM rt WHERE length(tok) >= 5),
    piece AS (SELECT DISTINCT tok AS word, substr(tok, CAST(place AS int), 5) AS five FROM word {{places(length(tok) - 4)}}),
    held AS (SELECT t.tok AS term, p.word FROM term t JOIN piece p ON p.five = substr(t.tok, 1, 5) WHERE contains(p.word, t.tok) GROUP BY t.tok, p.word),
    point AS (
        SELECT a.item_id, {r_key}, least(a.n, r.n) AS shared, 0 AS inside FROM asked a JOIN rt r ON a.tok = r.tok
        UNION ALL SELECT DISTINCT a.item_id, {r_key}, 0 AS shared, dense_rank() OVER (PARTITION BY a.item_id ORDER BY a.tok) AS inside FROM asked a JOIN held h ON h.term = a.tok JOIN rt r ON r.tok = h.word),
    score AS (SELECT p.item_id, {', '.join('p.' + k for k in on)}, round(CAST(sum(p.shared) AS double) / max(t.n) + 5e-2 * count(CASE WHEN p.inside > 0 THEN 1 END), 9) AS score FROM point p JOIN total t ON t.item_id = p.item_id GROUP BY p.item_id, {', '.join('p.' + k for k in on)})"""


def top(select: str, key: str, k: int) -> str:
    return f"SELECT {select}, score, rnk FROM (SELECT score.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {key}) AS rnk FROM score) w WHERE rnk <= {k}"


def ranked(rows: DataFrame, items: DataFrame, key: list[str], k: int) -> DataFrame:
    """item_id, key, score, rnk: the k best rows (key, text) of each item (item_id, text), as ``scored`` and ``top`` say.

    Rows are dealt by key before they are cut, and what each word meets is broadcast, some
    questions at a time, so points arise and are summed in one task: what a task
    holds is bounded by its rows and those questions, and only texts and each task's best are shuffled.
    """
    words = F.explode(F.expr(render(content("text"), 0)))
    dealt = rows.repartition(-(-rows.count() // ROWS) or 1, *key).select(*key, words.alias("word"))
    asked = kept(items.where("item_id IS NOT NULL").select("item_id", words.alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("asked_n")))
    total = asked.groupBy("item_id").agg(F.sum("asked_n").alias("total"))
    long_term = asked.where("length(term) >= 5").select("term", F.expr("substr(term, 1, 5)").alias("five")).distinct()
    piece = dealt.where("length(word) >= 5").select("word").distinct().select("word", F.expr("explode(array_distinct(transform(sequence(1, length(word) - 4), i -> substr(word, i, 5))))").alias("five"))
    held = piece.join(long_term, "five").where("contains(word, term)").select("term", "word").distinct()
    equal = asked.select("item_id", F.col("term").alias("word"), "term", "asked_n", F.lit(1).alias("equal"))
    inside = held.join(asked, "term").select("item_id", "word", "term", "asked_n", F.lit(0).alias("equal"))
    meets = kept(equal.union(inside).join(total, "item_id"))
    blocks = -(-meets.count() // MEETS) or 1
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), *key)

    def best(block):
        asking = F.broadcast(meets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        terms = dealt.join(asking, "word").groupBy("item_id", *key, "term").agg(F.least(F.max("asked_n"), F.sum("equal")).alias("shared"), F.max(1 - F.col("equal")).alias("inside"), F.max("total").alias("total"))
        score = F.round(F.sum("shared").cast("double") / F.max("total") + F.lit(5e-2) * F.sum("inside"), 9)
        return terms.groupBy("item_id", *key).agg(score.alias("score")).withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)

    return reduce(DataFrame.union, map(best, range(blocks))).select("item_id", *key, "score", "rnk")


def ranked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["conv_id", "turn"], 10)


def ranked_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = kept(Query("summaries", f"WITH {EPISODE} SELECT conv_id, summary AS text FROM episode")(spark, sf_dir))
    return ranked(summaries, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["conv_id"], 4)


#: The same rankings as one join of terms.
TURNS_BY_TERMS = f"WITH {scored('SELECT conv_id, turn, text FROM conversations', 'conv_id, turn')} {top('item_id, conv_id, turn', 'conv_id, turn', 10)}"
EPISODES_BY_TERMS = f"WITH {EPISODE}, {scored('SELECT conv_id, summary AS text FROM episode', 'conv_id')} {top('item_id, conv_id', 'conv_id', 4)}"
BUILT = {"o200_rank_by_lexical": (ranked_turns, render(TURNS_BY_TERMS, 1)), "o203_search_episodes": (ranked_episodes, render(EPISODES_BY_TERMS, 1))}

BUILT_STORE = (TURN, *STORE)
QUERIES = [
    Query("o270_predicate", f"SELECT conv_id, turn, coalesce({{nth({{ending({{tokens(text)}};ed;ing)}};1)}}, {{nth({{without({{tokens(text)}};{STOP})}};1)}}, '') AS predicate FROM conversations"),
    Plan("o440_components", BUILT_STORE, "SELECT scope, episode, turn, pos, text, subject, predicate, object_, time_expr, event_time, relation, component_id, nth_ FROM component"),
    Plan("o123_window_edges", BUILT_STORE, "SELECT scope, episode, l, r, edge_type, relation_text, made FROM edge"),
    Plan("o441_manifest", BUILT_STORE, "SELECT 'turns' AS part_, count(*) AS n FROM turn_ UNION ALL SELECT 'episodes' AS part_, count(DISTINCT episode) AS n FROM turn_ UNION ALL SELECT 'components' AS part_, count(*) AS n FROM component UNION ALL SELECT 'edges' AS part_, count(*) AS n FROM edge"),
    Query("o204_episode_summaries", f"WITH {EPISODE} SELECT conv_id, summary FROM episode"),
]
