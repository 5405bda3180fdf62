"""Retrieval plans over an evidence store: many questions at once, each stage one table.

A question belongs to a scope and is answered from that scope's components, edges and
turns. Its family routes it to a plan: a graph walk from the best components, an answer
slot tree (anchors, terminal candidates and bridge edges) or an evidence frame (roots and
terminals by intent); other families keep the context that they came with. Every choice
is a ranking within the question; the greedy ones, whose next choice depends on how many
were taken before, are counted with window functions, since what is taken can be told
from the rows before it alone.

Steps read ``turn_`` (see ``evidence``), ``question_`` (q, scope, text, question_type,
hop_type, answerability, dataset, asker) and ``base_`` (q, episode, turn: what an
upstream retriever found). ``retrieve`` takes DataFrames; the queries map the given
tables. Questions without a scope in the store, and empty tables, give empty context.
A question whose terms no component holds gets no repaired turns.
"""

import re
from dataclasses import replace

from pyspark.sql import DataFrame

from turnloom.sql import Plan, Step, run_steps

from .evidence import SEARCHED, STOP, STORE, TEMPORAL, TURN, content

METHODS = ("graph_walk_plan_routing", "answer_slot_tree_routing", "evidence_frame_routing")
# Words of a question that name no anchor; cues of intents; words that make a preference void; what a label can't start with.
GENERIC = "'does', 'did', 'done', 'have', 'having', 'kind', 'type', 'many', 'much', 'times', 'new', 'shared', 'significant', 'life', 'events', 'items', 'activities', 'locations', 'classes', 'sports', 'like', 'likes', 'liked', 'artist', 'artists', 'listen', 'listened', 'music', 'song', 'songs', 'used'"
PAST = ("used to", "as a kid", "childhood", "when he was a kid", "when she was a kid")
LIKING = ("like", "love", "enjoy", "favorite", "prefer", "stoked")
SETS = ("which", "what items", "what events", "what activities", "what states", "what countries", "what locations", "what classes", "what poses", "two ", "both", "shared", "items", "events", "activities", "states", "countries", "locations", "classes", "poses")
COUNTS = "'once', 'twice', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'"
PRONOUNS = "'it', 'this', 'that', 'these', 'those', 'them', 'our', 'my', 'your', 'his', 'her', 'their', 'its'"
BAD_STARTS = PRONOUNS + ", 'for', 'and', 'to', 'with', 'of', 'about'"
NO_LABEL = "'it', 'this', 'that', 'these', 'those', 'them', 'our', 'my', 'your', 'his', 'her', 'their', 'for', 'and', 'to', 'with', 'of', 'about'"
HABITS = ("used to", "as a kid", "when i was a kid", "childhood", "those were the days", "back then")
HABIT_ASKED = ("used to", "as a kid", "when he was a kid", "when she was a kid", "when they were kids", "childhood")
SUGGESTIONS = ("have you considered", "what do you", "maybe we can", "could try")
YES_NO = ("yes", "no", "want", "wants", "plan", "plans", "can", "cannot", "can't")
#: Fixed values by method: components searched, edges kept, episodes repaired, turns shown; and the limits of roots and terminals.
BUDGET = {"graph-temporal": (18, 18, 3, 16), "graph-multi-hop": (20, 24, 3, 16), "slot": (48, 10, 2, 14), "frame": (64, 8, 2, 16)}
ANCHORS, SLOT_TERMINALS, ROOTS, FRAME_TERMINALS = 8, 8, 6, 10
#: What an edge's type adds to its score.
WALK_BONUS = {"temporal": {"temporal_near": 0.35, "same_entity": 0.25, "source_of": 0.2, "same_session": 0.15}, "multi-hop": {"same_entity": 0.35, "source_of": 0.28, "same_session": 0.22, "event-update": 0.18}}
BRIDGE_BONUS = {"same_entity": 0.35, "source_of": 0.25, "same_session": 0.15}
WALK_TYPES = {"temporal": ("temporal_near", "same_entity", "source_of", "same_session"), "multi-hop": ("same_entity", "source_of", "same_session", "event-update", "causal", "preference/attribute", "social")}
# Risk, components, edges and episodes by family, and the relations that a family asks for.
BUDGETS = """(VALUES ('temporal', 'high', 12, 10, 2), ('open-domain', 'high', 14, 12, 3), ('multi-hop', 'medium', 16, 6, 3), ('adversarial', 'high', 8, 0, 2), ('longdialogue', 'medium', 10, 4, 2), ('single-hop', 'low', 8, 0, 1))"""
RELATIONS = {
    "temporal": ("temporal", "temporal_near", "event-update", "entity", "same_entity", "same_session", "source_of"),
    "open-domain": ("causal", "preference/attribute", "social", "entity", "same_entity", "event-update", "source_of"),
    "adversarial": ("entity", "same_entity", "event-update", "temporal", "temporal_near", "conflict_with", "source_of"),
}


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'" if "'" not in word else "concat(" + ", chr(39), ".join(f"'{p}'" for p in word.split("'")) + ")"


def any_in(column: str, words) -> str:
    return "(" + " OR ".join(f"{{inside({column};{quoted(w)})}}" for w in words) + ")"


def fixed3(x: str) -> str:
    """A number with three digits after the point, ties to even."""
    ninths = f"CAST(round(abs({x}) * 1000000000) AS bigint)"
    whole, rest = f"CAST(floor({ninths} / 1000000.0) AS bigint)", f"({ninths} % 1000000)"
    k = f"({whole} + CASE WHEN {rest} > 500000 OR ({rest} = 500000 AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {x} < 0 AND {k} > 0 THEN '-' ELSE '' END || CAST(floor({k} / 1000.0) AS bigint) || '.' || right('00' || ({k} % 1000), 3))"


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def cases(by: str, table: dict, other: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS double)" for k, v in table.items()) + f" ELSE CAST({other} AS double) END"


def expansion(conditions) -> str:
    return "concat_ws(' ', text" + "".join(f", CASE WHEN {c} THEN '{words}' END" for c, words in conditions) + ")"


def best(rows: str, q: str, order: str, k: str, name: str = "rnk") -> str:
    return f"SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY {q} ORDER BY {order}) AS {name} FROM ({rows}) x) y WHERE {name} <= {k}"


QUESTION = Step("question_", "SELECT item_id AS q, item_id % (SELECT max(scope) + 1 FROM turn_) AS scope, coalesce(text, '') AS text, CASE item_id % 4 WHEN 0 THEN 'temporal' WHEN 3 THEN 'unanswerable' ELSE '' END AS question_type, CASE WHEN item_id % 4 = 1 THEN 'two_hop' ELSE '' END AS hop_type, '' AS answerability, '' AS dataset, '' AS asker FROM benchmark")

TURN_QUESTION = Step("question_", "SELECT conv_id * 1000000 + turn AS q, conv_id AS scope, coalesce(text, '') AS text, '' AS question_type, '' AS hop_type, '' AS answerability, '' AS dataset, '' AS asker FROM conversations WHERE role = 'user'")

#: Turns of the scopes that some question asks: no question meets another's, so Spark builds the store and the lines of these alone.
ASKED_TURN = Step("asked_turn", "", spark="SELECT t.* FROM turn_ t LEFT SEMI JOIN (SELECT DISTINCT scope FROM question_) s ON s.scope = t.scope")


def of_asked(steps) -> tuple:
    """The steps, in Spark over the turns of asked scopes."""
    return ASKED_TURN, *(replace(s, spark=re.sub(r"\bturn_\b", "asked_turn", s.of(0))) for s in steps)


ASKED = (
    Step(
        "framed",
        f"""SELECT q, scope, text, low, slot, family, dataset, asker, past, liking, sets,
            concat_ws(',', CASE WHEN past THEN 'past_habit' END, CASE WHEN liking THEN 'preference' END, CASE WHEN sets THEN 'set_answer' END, CASE WHEN slot = 'count' THEN 'count' END, CASE WHEN slot = 'location' THEN 'location' END,
                CASE WHEN NOT past AND NOT liking AND NOT sets AND slot NOT IN ('count', 'location') THEN 'entity_attribute' END) AS intents,
            {any_in('low', HABIT_ASKED)} AS habit_asked,
            {expansion([(any_in('low', ('like',)), 'love loves loved enjoy enjoys favorite stoked'), (any_in('low', ('child', 'kid')), 'child children kids family'), (any_in('low', ('used to', 'as a kid', 'childhood')), 'used to back then childhood those were the days'), (any_in('low', ('artist', 'listen')), 'music song artist band listened'), (any_in('low', ('shared', 'both')), 'both together also')])} AS slot_query,
            {expansion([('liking', 'love loved enjoy favorite stoked'), ('past', 'used to back then childhood those were the days'), ('sets', 'and also both together'), (any_in('low', ('child', 'kid')), 'child children kids family'), (any_in('low', ('listen',)), 'song listened')])} AS frame_query
        FROM (SELECT q, scope, text, low, dataset, asker, {any_in('low', PAST)} AS past, {any_in('low', LIKING)} AS liking, {any_in('low', SETS)} AS sets,
                CASE WHEN {{begins(low;'when')}} OR {any_in('low', (' what date', 'which date'))} THEN 'date/time' WHEN {{inside(low;'how long')}} THEN 'duration' WHEN {any_in('low', ('how many', 'number of'))} THEN 'count'
                     WHEN {{begins(low;'who')}} THEN 'person/entity' WHEN {{begins(low;'where')}} THEN 'location' WHEN {{begins(low;'did ')}} OR {{begins(low;'was ')}} OR {{begins(low;'is ')}} THEN 'yes/no' ELSE 'entity/attribute' END AS slot,
                CASE WHEN {{inside(kind;'unans')}} OR lower(answerability) = 'unanswerable' THEN 'adversarial'
                     WHEN {{inside(kind;'temporal')}} OR {{inside(hop;'temporal')}} OR {{size({{among(toks;{TEMPORAL})}})}} > 0 THEN 'temporal'
                     WHEN {{inside(hop;'two_hop')}} OR {{inside(kind;'multi')}} THEN 'multi-hop'
                     WHEN {{inside(kind;'open')}} OR {any_in('spoken', ('why', 'reason', 'should', 'would', 'could'))} THEN 'open-domain'
                     WHEN dataset = 'longdialqa' THEN 'longdialogue' ELSE 'single-hop' END AS family
            FROM (SELECT q, scope, text, lower(text) AS low, lower(question_type) AS kind, lower(hop_type) AS hop, coalesce(answerability, '') AS answerability, coalesce(dataset, '') AS dataset, coalesce(asker, '') AS asker, {content('text')} AS toks, {{joined({content('text')}; )}} AS spoken
                FROM (SELECT q, scope, coalesce(text, '') AS text, coalesce(question_type, '') AS question_type, coalesce(hop_type, '') AS hop_type, answerability, dataset, asker FROM question_) a) b) c""",
        keep=True,
    ),
    Step("stemmed", f"SELECT q, pos, CASE WHEN {{ends(tok;chr(39) || 's')}} THEN substr(tok, 1, length(tok) - 2) ELSE tok END AS tok FROM (SELECT q, {content('text')} AS toks FROM framed) f {{posexplode(toks)}}"),
    Step("offered", f"SELECT q, 3 * pos AS at_, tok FROM stemmed WHERE tok NOT IN ({GENERIC}) UNION ALL SELECT q, 3 * pos + 1 AS at_, substr(tok, 1, length(tok) - 1) AS tok FROM stemmed WHERE tok NOT IN ({GENERIC}) AND {{ends(tok;'s')}} AND length(tok) > 4 AND substr(tok, 1, length(tok) - 1) NOT IN ({GENERIC}) UNION ALL SELECT q, 3 * pos + 2 AS at_, 'tried' AS tok FROM stemmed WHERE tok = 'try'"),
    Step("anchor_term", "SELECT q, tok, rnk FROM (SELECT q, tok, row_number() OVER (PARTITION BY q ORDER BY min(at_)) AS rnk FROM offered GROUP BY q, tok) x WHERE rnk <= 12"),
    Step("asked", f"SELECT f.q, f.scope, f.text, f.low, f.slot, f.family, f.dataset, f.asker, f.past, f.liking, f.sets, f.intents, f.habit_asked, coalesce(a.terms, {{cut('')}}) AS terms, coalesce(a.n, 0) AS n_terms, {{at_least_4({content('f.text')})}} AS long_terms FROM framed f LEFT JOIN (SELECT q, {{collect(tok;rnk)}} AS terms, count(*) AS n FROM anchor_term GROUP BY q) a ON a.q = f.q", keep=True),
)

SEARCH = (
    Step("query_", "SELECT q, scope, 'plain' AS variant, text FROM framed UNION ALL SELECT q, scope, 'slot' AS variant, slot_query AS text FROM framed UNION ALL SELECT q, scope, 'frame' AS variant, frame_query AS text FROM framed"),
    Step("query_term", f"SELECT q, scope, variant, tok, count(*) AS n FROM (SELECT q, scope, variant, {content('text')} AS toks FROM query_) x {{explode(toks)}} GROUP BY q, scope, variant, tok"),
    Step("query_size", "SELECT q, variant, sum(n) AS n FROM query_term GROUP BY q, variant"),
    Step("component_term", f"SELECT scope, episode, nth_, tok, count(*) AS n, sum(own) AS own FROM (SELECT scope, episode, nth_, 1 AS own, tok FROM (SELECT scope, episode, nth_, {content('text')} AS toks FROM component) a {{explode(toks)}} UNION ALL SELECT scope, episode, nth_, 0 AS own, tok FROM (SELECT scope, episode, nth_, {content(SEARCHED)} AS toks FROM component) b {{explode(toks)}}) c GROUP BY scope, episode, nth_, tok", keep=True),
    Step("long_word", "SELECT DISTINCT tok FROM component_term WHERE length(tok) >= 5"),
    Step("long_term", "SELECT DISTINCT tok FROM query_term WHERE length(tok) >= 5"),
    Step("piece", "SELECT DISTINCT tok AS word, substr(tok, CAST(place AS int), 5) AS five FROM long_word {places(length(tok) - 4)}"),
    Step("held", "SELECT t.tok AS term, p.word FROM long_term t JOIN piece p ON p.five = substr(t.tok, 1, 5) WHERE {inside(p.word;t.tok)} GROUP BY t.tok, p.word"),
    Step("hit_equal", "SELECT a.q, a.variant, c.episode, c.nth_, a.tok, a.n AS asked_n, c.n, c.own FROM query_term a JOIN component_term c ON c.scope = a.scope AND c.tok = a.tok", keep=True),
    Step("hit_inside", "SELECT a.q, a.variant, c.episode, c.nth_, a.tok, max(c.own) AS own FROM query_term a JOIN held h ON h.term = a.tok JOIN component_term c ON c.scope = a.scope AND c.tok = h.word GROUP BY a.q, a.variant, c.episode, c.nth_, a.tok", keep=True),
    Step("point", "SELECT q, variant, episode, nth_, sum(least(asked_n, n)) AS shared, 0 AS inside FROM hit_equal GROUP BY q, variant, episode, nth_ UNION ALL SELECT q, variant, episode, nth_, 0 AS shared, count(*) AS inside FROM hit_inside GROUP BY q, variant, episode, nth_"),
    Step("hit", "SELECT p.q, p.variant, p.episode, p.nth_, round(CAST(sum(p.shared) AS double) / max(s.n) + 5e-2 * sum(p.inside), 9) AS score FROM point p JOIN query_size s ON s.q = p.q AND s.variant = p.variant GROUP BY p.q, p.variant, p.episode, p.nth_"),
    Step("best_hit", best("SELECT q, variant, episode, nth_, score FROM hit", "q, variant", "score DESC, episode, nth_", "64"), keep=True),
)

#: The queries' upstream retriever: the turns of the two best components.
BASE = Step("base_", "SELECT DISTINCT h.q, h.episode, c.turn FROM best_hit h JOIN framed f ON f.q = h.q JOIN component c ON c.scope = f.scope AND c.episode = h.episode AND c.nth_ = h.nth_ WHERE h.variant = 'plain' AND h.rnk <= 2")
SHOWN = "'[' || coalesce('Date: ' || {long_date(t.said_on)} || '; ', '') || 'Scene: ' || t.episode || '; Turn: D' || t.episode || ':' || t.turn || '] Speaker ' || coalesce(nullif(t.speaker, ''), 'unknown') || ' says: ' || coalesce(t.text, '')"
TURNS = (
    Step("turn_line", f"SELECT t.scope, t.episode, t.turn, t.speaker, row_number() OVER (PARTITION BY t.scope, t.episode ORDER BY t.turn) AS idx, {{at_least_4({content("coalesce(t.text, '')")})}} AS long_terms, {SHOWN} AS shown FROM turn_ t", keep=True),
    Step("base_line", "SELECT b.q, t.episode, t.turn, t.shown, row_number() OVER (PARTITION BY b.q ORDER BY t.episode, t.turn) AS at_ FROM base_ b JOIN framed f ON f.q = b.q JOIN turn_line t ON t.scope = f.scope AND t.episode = b.episode AND t.turn = b.turn"),
    Step("base_context", "SELECT q, {joined_lines({collect(shown;at_)})} AS context FROM base_line GROUP BY q"),
)

LIMITS = "SELECT * FROM (VALUES " + ", ".join(f"('{plan}', {', '.join(map(str, n))})" for plan, n in BUDGET.items()) + ") AS v(plan, n_components, n_edges, n_episodes, n_turns)"
#: The plans that some method sends a question of this family to.
TASK = Step("task", f"SELECT a.q, a.scope, l.plan, a.family, a.slot, l.n_components, l.n_edges, l.n_episodes, l.n_turns FROM asked a JOIN ({LIMITS}) l ON (a.family = 'temporal' AND l.plan = 'graph-temporal') OR (a.family = 'multi-hop' AND l.plan IN ('graph-multi-hop', 'slot', 'frame'))", keep=True)

PREFERRED = f"""CASE WHEN NOT {any_in('low', ('love', 'like', 'enjoy', 'favorite', 'stoked', 'fan of'))} OR {any_in('low', ('sounds like', 'looks like'))} THEN 0.0
    WHEN liked IS NULL THEN 0.25 WHEN {{got_first_word(liked)}} IN ({BAD_STARTS}) OR coalesce({{nth({content('liked')};1)}}, '') IN ({BAD_STARTS}) THEN -0.12
    WHEN {{size({{without({content('liked')};{PRONOUNS})}})}} > 0 THEN 0.55 ELSE -0.12 END"""
SEVERAL = "({inside(text;',')} OR {inside(low;' and ')})"
NAMED = "{has_entity(plain)}"
SLOT_BONUS = f"""CASE slot WHEN 'count' THEN CASE WHEN {{has_number(lower(plain))}} OR {{size({{among({{split_ws(low)}};{COUNTS})}})}} > 0 THEN 0.45 ELSE 0.0 END WHEN 'person/entity' THEN CASE WHEN {NAMED} THEN 0.25 ELSE 0.0 END
    WHEN 'location' THEN CASE WHEN {{has_at_place(plain)}} THEN 0.2 ELSE 0.0 END WHEN 'yes/no' THEN CASE WHEN {any_in('low', YES_NO)} THEN 0.25 ELSE 0.0 END
    ELSE preferred + CASE WHEN {SEVERAL} THEN 0.18 ELSE 0.0 END + CASE WHEN {NAMED} THEN 0.12 ELSE 0.0 END END"""
SUGGESTED = f"({{inside(text;'?')}} OR {any_in('low', SUGGESTIONS)})"
VALUE = "coalesce(nullif({got_liked_label(low)}, ''), nullif({got_stoked_label(low)}, ''), nullif({got_favorite_label(low)}, ''))"
LABEL = f"""CASE WHEN past AND habit_value <> '' THEN {{short(habit_value;80)}} WHEN liking AND {any_in('low', ('sounds like', 'looks like'))} THEN ''
    WHEN liking AND value IS NOT NULL THEN CASE WHEN {{got_first_word(substr(value, 1, 30))}} IN ({NO_LABEL}) THEN '' ELSE {{short(value;80)}} END
    WHEN sets AND {SUGGESTED} THEN '' WHEN sets AND {SEVERAL} THEN {{short(text;100)}} ELSE '' END"""

SCORED = (
    Step("base_component", "SELECT DISTINCT b.q, c.episode, c.nth_ FROM base_ b JOIN framed f ON f.q = b.q JOIN component c ON c.scope = f.scope AND c.episode = b.episode AND c.turn = b.turn"),
    Step("candidate", "SELECT q, plan, episode, nth_, max(score) AS score, max(base) AS base, min(rnk) AS rnk FROM (SELECT t.q, t.plan, h.episode, h.nth_, h.score, 0 AS base, h.rnk FROM task t JOIN best_hit h ON h.q = t.q AND h.variant = t.plan WHERE h.rnk <= t.n_components UNION ALL SELECT t.q, t.plan, b.episode, b.nth_, CAST(0 AS double) AS score, 1 AS base, 1000 AS rnk FROM task t JOIN base_component b ON b.q = t.q WHERE t.plan IN ('slot', 'frame')) x GROUP BY q, plan, episode, nth_"),
    Step(
        "worded",
        f"""SELECT d.q, d.plan, d.episode, d.nth_, d.score, d.base, d.rnk, c.turn, c.text, c.relation, a.slot, a.past, a.liking, a.sets, a.habit_asked, a.terms, a.n_terms, lower(c.text) AS low, {{blank_letter_beyond_ascii(c.text)}} AS plain,
            {{common({{distinct({content("concat_ws(' ', c.text, c.subject, c.object_, c.predicate, c.speaker)")})}};a.terms)}} AS met, {{common({{distinct({content('c.text')})}};a.terms)}} AS met_in_text
        FROM candidate d JOIN asked a ON a.q = d.q JOIN component c ON c.scope = a.scope AND c.episode = d.episode AND c.nth_ = d.nth_""",
    ),
    Step("liked_", "SELECT worded.*, substr(coalesce(nullif({got_liked(lower(plain))}, ''), nullif({got_stoked(lower(plain))}, ''), nullif({got_fan(lower(plain))}, ''), nullif({got_favorite(lower(plain))}, '')), 1, 61) AS liked, trim({got_habit_label(low)}) AS habit_value, trim(" + VALUE + ") AS value FROM worded"),
    Step("preferring", f"SELECT liked_.*, CAST({PREFERRED} AS double) AS preferred, CAST(CASE WHEN {any_in('low', HABITS)} THEN 0.65 ELSE 0.0 END AS double) AS habit FROM liked_"),
    Step(
        "bonused",
        f"""SELECT preferring.*, CAST({SLOT_BONUS} AS double) AS slot_bonus, CAST(CASE WHEN {SEVERAL} THEN 0.22 ELSE 0.0 END + CASE WHEN {{size({{all_entity(plain)}})}} >= 2 THEN 0.18 ELSE 0.0 END AS double) AS set_bonus,
            CAST(CASE WHEN {{begins(low;'[image:')}} AND {{size({content('text')})}} < 8 THEN 0.15 ELSE 0.0 END + CASE WHEN (liking OR past) AND {any_in('low', ('looks like', 'sounds like', "that's awesome", 'that sounds'))} THEN 0.2 ELSE 0.0 END + CASE WHEN sets AND {SUGGESTED} THEN 0.35 ELSE 0.0 END AS double) AS penalty,
            {LABEL} AS label
        FROM preferring""",
    ),
    Step("answering", "SELECT bonused.*, CAST(slot_bonus + CASE WHEN past THEN habit ELSE 0.0 END + CASE WHEN sets THEN set_bonus ELSE 0.0 END - CASE WHEN liking AND preferred < 0 THEN 0.35 ELSE 0.0 END AS double) AS answer FROM bonused"),
    Step(
        "scored_component",
        """SELECT z.*, row_number() OVER (PARTITION BY q, plan ORDER BY total DESC, rnk, episode, nth_) AS place FROM (SELECT y.*, round(CAST(score + CAST(met AS double) / greatest(1, n_terms) + CASE WHEN relation IN ('entity', 'social', 'preference/attribute', 'causal') THEN 0.08 ELSE 0.0 END
            + CASE WHEN plan = 'slot' THEN slot_bonus + CASE WHEN habit_asked THEN habit ELSE 0.0 END + base * 0.22 ELSE answer + base * 0.18 - penalty END AS double), 9) AS total FROM answering y) z""",
        keep=True,
    ),
)


def counted(rows: str, accept: str) -> str:
    """The rows with ``taken``: how many rows up to this one (in order of place) are accepted."""
    return f"SELECT w.*, sum(CASE WHEN {accept} THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken, CASE WHEN {accept} THEN 1 ELSE 0 END AS accepted FROM ({rows}) w"


def filled(rows: str, limit: int) -> str:
    """Accepted rows first, at most ``limit``; what is missing then comes from the others, in order of place."""
    return best(f"SELECT q, plan, episode, nth_, place, label, answer, slot_bonus, total, CASE WHEN accepted = 1 AND taken <= {limit} THEN 0 ELSE 1 END AS late FROM ({rows}) v", "q", "late, place", str(limit), "nth_choice")


ROOT_ROWS = counted("SELECT u.*, sum(CASE WHEN matched = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth_match, row_number() OVER (PARTITION BY q, matched, episode, turn ORDER BY place) AS of_turn FROM (SELECT s.*, CASE WHEN n_terms = 0 OR met_in_text > 0 THEN 1 ELSE 0 END AS matched FROM scored_component s WHERE plan = 'frame') u", f"matched = 1 AND (nth_match <= {max(3, ROOTS // 2)} OR of_turn = 1)")
NEW_LABEL = "(label = '' OR of_label = 1)"
TERMINAL_ROWS = counted(f"SELECT u.*, sum(CASE WHEN {NEW_LABEL} THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS offered_ FROM (SELECT s.*, row_number() OVER (PARTITION BY q, lower(label) ORDER BY place) AS of_label FROM scored_component s WHERE plan = 'frame') u", f"{NEW_LABEL} AND (label <> '' OR offered_ <= {max(4, FRAME_TERMINALS // 2)})")

def edge_search(name: str, wanted: str) -> tuple:
    """Steps of a lexical search over the edges that ``wanted`` lists (with n_edges, a limit): ``{name}_found``.

    Terms are counted once a component and summed over an edge's two, so no edge's text is built.
    """
    key = "q, plan, episode, l, r, source"
    w = ", ".join(f"w.{k}" for k in key.split(", "))
    ends = [f"SELECT {w}, h.tok, h.asked_n, h.own AS n FROM {wanted} w JOIN hit_equal h ON h.q = w.q AND h.variant = 'plain' AND h.episode = w.episode AND h.nth_ = w.{end}" for end in "lr"]
    holds = [f"SELECT {w}, h.tok FROM {wanted} w JOIN hit_inside h ON h.q = w.q AND h.variant = 'plain' AND h.episode = w.episode AND h.nth_ = w.{end} WHERE h.own > 0" for end in "lr"]
    return (
        Step(f"{name}_word", f"SELECT {key}, tok, count(*) AS n FROM (SELECT {key}, {content("edge_type || ' ' || relation_text")} AS toks FROM {wanted}) w {{explode(toks)}} GROUP BY {key}, tok"),
        Step(f"{name}_hit", f"SELECT {key}, tok, max(asked_n) AS asked_n, sum(n) AS n FROM ({' UNION ALL '.join(ends)} UNION ALL SELECT {w}, w.tok, t.n AS asked_n, w.n FROM {name}_word w JOIN query_term t ON t.q = w.q AND t.variant = 'plain' AND t.tok = w.tok) x GROUP BY {key}, tok"),
        Step(f"{name}_holds", f"SELECT {key}, tok FROM ({' UNION ALL '.join(holds)} UNION ALL SELECT {w}, t.tok FROM {wanted} w JOIN query_term t ON t.q = w.q AND t.variant = 'plain' WHERE length(t.tok) >= 5 AND {{inside(lower(w.edge_type || ' ' || w.relation_text);t.tok)}}) x GROUP BY {key}, tok"),
        Step(f"{name}_point", f"SELECT {key}, sum(least(asked_n, n)) AS shared, 0 AS inside FROM {name}_hit GROUP BY {key} UNION ALL SELECT {key}, 0 AS shared, count(*) AS inside FROM {name}_holds GROUP BY {key}"),
        Step(f"{name}_score", f"SELECT {', '.join('p.' + k for k in key.split(', '))}, round(CAST(sum(p.shared) AS double) / max(s.n) + 5e-2 * sum(p.inside), 9) AS score FROM {name}_point p JOIN query_size s ON s.q = p.q AND s.variant = 'plain' GROUP BY {', '.join('p.' + k for k in key.split(', '))}"),
        Step(f"{name}_found", f"SELECT * FROM (SELECT w.*, s.score, row_number() OVER (PARTITION BY w.q, w.plan ORDER BY s.score DESC, w.episode, w.made, w.l, w.source, w.r) AS rnk FROM {wanted} w JOIN {name}_score s ON s.q = w.q AND s.plan = w.plan AND s.episode = w.episode AND s.l = w.l AND s.r = w.r AND s.source = w.source WHERE s.score > 0) x WHERE rnk <= n_edges"),
    )


CHOICES = (
    Step("anchor", f"SELECT q, plan, episode, nth_, place AS nth_choice, total, slot_bonus, label, answer FROM scored_component WHERE plan = 'slot' AND place <= {ANCHORS} UNION ALL SELECT q, plan, episode, nth_, nth_choice, total, slot_bonus, label, answer FROM ({filled(ROOT_ROWS, ROOTS)}) r", keep=True),
    Step("terminal", f"SELECT q, plan, episode, nth_, nth_choice, total, slot_bonus, label, answer FROM ({filled(counted(chr(32).join(['SELECT s.* FROM scored_component s', 'WHERE', 'plan', '=', repr('slot')]), f'place <= {max(3, SLOT_TERMINALS // 2)} OR slot_bonus > 0'), SLOT_TERMINALS)}) r UNION ALL SELECT q, plan, episode, nth_, taken AS nth_choice, total, slot_bonus, label, answer FROM ({TERMINAL_ROWS}) t WHERE accepted = 1 AND taken <= {FRAME_TERMINALS}", keep=True),
    Step("bridging", "SELECT a.q, a.plan, k.scope, e.episode, e.l, e.r, e.source FROM anchor a JOIN task k ON k.q = a.q AND k.plan = a.plan JOIN terminal t ON t.q = a.q AND t.plan = a.plan AND t.episode = a.episode JOIN edge e ON e.scope = k.scope AND e.episode = a.episode AND e.l = a.nth_ AND e.r = t.nth_ UNION SELECT a.q, a.plan, k.scope, e.episode, e.l, e.r, e.source FROM anchor a JOIN task k ON k.q = a.q AND k.plan = a.plan JOIN terminal t ON t.q = a.q AND t.plan = a.plan AND t.episode = a.episode JOIN edge e ON e.scope = k.scope AND e.episode = a.episode AND e.l = t.nth_ AND e.r = a.nth_"),
    Step("walk_anchor", "SELECT t.q, t.plan, t.scope, h.episode, h.nth_, h.rnk, h.score FROM task t JOIN best_hit h ON h.q = t.q WHERE h.variant = 'plain' AND h.rnk <= t.n_components AND t.plan IN ('graph-temporal', 'graph-multi-hop')", keep=True),
    Step("walking", "SELECT a.q, a.plan, a.scope, e.episode, e.l, e.r, e.source FROM walk_anchor a JOIN edge e ON e.scope = a.scope AND e.episode = a.episode AND e.l = a.nth_ UNION SELECT a.q, a.plan, a.scope, e.episode, e.l, e.r, e.source FROM walk_anchor a JOIN edge e ON e.scope = a.scope AND e.episode = a.episode AND e.r = a.nth_"),
    Step(
        "edge_candidate",
        f"""SELECT x.q, x.plan, x.scope, x.episode, x.l, x.r, x.source, e.edge_type, e.relation_text, e.made, a.family, a.terms, a.n_terms, a.long_terms, left_.text AS left_text, right_.text AS right_text, left_.turn AS left_turn, right_.turn AS right_turn,
            CASE WHEN left_.time_expr <> '' OR right_.time_expr <> '' THEN 1 ELSE 0 END AS timed, {{distinct({content("concat_ws(' ', e.edge_type, e.relation_text, left_.text, right_.text)")})}} AS words, {content("concat_ws(' ', left_.event_time, right_.event_time)")} AS times
        FROM (SELECT * FROM bridging UNION ALL SELECT * FROM walking) x JOIN asked a ON a.q = x.q JOIN edge e ON e.scope = x.scope AND e.episode = x.episode AND e.l = x.l AND e.r = x.r AND e.source = x.source
        JOIN component left_ ON left_.scope = x.scope AND left_.episode = x.episode AND left_.nth_ = x.l JOIN component right_ ON right_.scope = x.scope AND right_.episode = x.episode AND right_.nth_ = x.r""",
    ),
    Step(
        "met_edge",
        f"""SELECT q, plan, scope, episode, l, r, source, edge_type, relation_text, made, left_text, right_text, left_turn, right_turn, 0 AS searched, round(CAST(CASE
            WHEN plan IN ('slot', 'frame') THEN CAST({{common(words;terms)}} AS double) / greatest(1, n_terms) + {cases('edge_type', BRIDGE_BONUS, '0.1')}
            ELSE CAST({{common(words;long_terms)}} + {{common({{distinct({{times_beyond(times;words)}})}};long_terms)}} AS double) / greatest(1, {{size(long_terms)}}) + CASE WHEN family = 'temporal' THEN {cases('edge_type', WALK_BONUS['temporal'], '0.1')} + timed * 0.12 ELSE {cases('edge_type', WALK_BONUS['multi-hop'], '0.1')} END END AS double), 9) AS score FROM edge_candidate""",
        keep=True,
    ),
    # A walk that met too few edges takes more from a search over the edges of the scope.
    Step("short_walk", "SELECT t.q, t.plan, t.scope, t.family, t.n_edges FROM task t JOIN (SELECT DISTINCT q, plan FROM walk_anchor) w ON w.q = t.q AND w.plan = t.plan LEFT JOIN (SELECT q, plan, count(*) AS n FROM met_edge GROUP BY q, plan) m ON m.q = t.q AND m.plan = t.plan WHERE coalesce(m.n, 0) < t.n_edges"),
    Step("wanted_edge", f"SELECT k.q, k.plan, k.n_edges, e.scope, e.episode, e.l, e.r, e.source, e.edge_type, e.relation_text, e.made FROM short_walk k JOIN edge e ON e.scope = k.scope AND ((k.family = 'temporal' AND e.edge_type IN ({listed(WALK_TYPES['temporal'])})) OR (k.family = 'multi-hop' AND e.edge_type IN ({listed(WALK_TYPES['multi-hop'])})))"),
    *edge_search("walk", "wanted_edge"),
    Step("more_edge", "SELECT s.q, s.plan, s.scope, s.episode, s.l, s.r, s.source, s.edge_type, s.relation_text, s.made, left_.text AS left_text, right_.text AS right_text, left_.turn AS left_turn, right_.turn AS right_turn, 1 AS searched, s.score FROM walk_found s LEFT JOIN met_edge m ON m.q = s.q AND m.plan = s.plan AND m.episode = s.episode AND m.l = s.l AND m.r = s.r AND m.source = s.source JOIN component left_ ON left_.scope = s.scope AND left_.episode = s.episode AND left_.nth_ = s.l JOIN component right_ ON right_.scope = s.scope AND right_.episode = s.episode AND right_.nth_ = s.r WHERE m.q IS NULL"),
    Step("path", "SELECT x.q, x.plan, x.episode, x.l, x.r, x.edge_type, x.relation_text, x.left_text, x.right_text, x.left_turn, x.right_turn, x.score, x.rnk FROM (SELECT y.*, row_number() OVER (PARTITION BY q, plan ORDER BY score DESC, searched, episode, made, l, source, r) AS rnk FROM (SELECT * FROM met_edge UNION ALL SELECT * FROM more_edge) y) x JOIN task t ON t.q = x.q AND t.plan = x.plan WHERE x.rnk <= t.n_edges", keep=True),
    Step(
        "chosen",
        """SELECT q, plan, episode, nth_, role, score, row_number() OVER (PARTITION BY q, plan ORDER BY at_) AS place FROM (SELECT z.*, row_number() OVER (PARTITION BY q, plan, episode, nth_ ORDER BY at_) AS again FROM (
            SELECT q, plan, episode, nth_, CASE WHEN plan = 'slot' THEN 'anchor' ELSE 'root' END AS role, total AS score, nth_choice AS at_ FROM anchor
            UNION ALL SELECT q, plan, episode, nth_, 'terminal' AS role, total AS score, 100 + nth_choice AS at_ FROM terminal
            UNION ALL SELECT q, plan, episode, nth_, 'anchor' AS role, score, rnk AS at_ FROM walk_anchor
            UNION ALL SELECT q, plan, episode, l AS nth_, CASE WHEN plan LIKE 'graph%' THEN 'walk_neighbor' ELSE 'terminal' END AS role, CAST(0 AS double) AS score, 200 + 2 * rnk AS at_ FROM path
            UNION ALL SELECT q, plan, episode, r AS nth_, CASE WHEN plan LIKE 'graph%' THEN 'walk_neighbor' ELSE 'terminal' END AS role, CAST(0 AS double) AS score, 201 + 2 * rnk AS at_ FROM path) z) y WHERE again = 1""",
        keep=True,
    ),
)

REPAIR = (
    Step("source_turn", "SELECT DISTINCT k.q, k.plan, k.scope, h.episode, c.turn, l.idx FROM chosen h JOIN task k ON k.q = h.q AND k.plan = h.plan JOIN component c ON c.scope = k.scope AND c.episode = h.episode AND c.nth_ = h.nth_ JOIN turn_line l ON l.scope = k.scope AND l.episode = h.episode AND l.turn = c.turn"),
    Step("repaired_episode", "SELECT e.q, e.plan, e.scope, e.episode, e.nth_episode FROM (SELECT q, plan, scope, episode, row_number() OVER (PARTITION BY q, plan ORDER BY episode) AS nth_episode FROM source_turn GROUP BY q, plan, scope, episode) e JOIN task k ON k.q = e.q AND k.plan = e.plan WHERE e.nth_episode <= k.n_episodes"),
    Step("near_turn", "SELECT DISTINCT q, plan, scope, episode, place AS idx FROM (SELECT s.q, s.plan, s.scope, s.episode, s.idx FROM source_turn s JOIN repaired_episode e ON e.q = s.q AND e.plan = s.plan AND e.episode = s.episode) x {upto(idx - 2;idx + 2)}"),
    Step("pool", "SELECT q, plan, scope, episode, idx, 'source' AS kind FROM source_turn UNION ALL SELECT n.q, n.plan, n.scope, n.episode, n.idx, 'repaired' AS kind FROM near_turn n JOIN turn_line t ON t.scope = n.scope AND t.episode = n.episode AND t.idx = n.idx"),
    Step("pooled", "SELECT p.q, p.plan, p.kind, t.scope, t.episode, t.turn, t.idx, t.speaker, t.shown, k.n_turns, {common(t.long_terms;a.long_terms)} AS met, count(*) OVER (PARTITION BY p.q, p.plan) AS n FROM pool p JOIN task k ON k.q = p.q AND k.plan = p.plan JOIN asked a ON a.q = p.q JOIN turn_line t ON t.scope = p.scope AND t.episode = p.episode AND t.idx = p.idx"),
    Step("shown_turn", "SELECT q, plan, kind, episode, turn, speaker, shown, row_number() OVER (PARTITION BY q, plan ORDER BY episode, turn, kind DESC) AS at_ FROM (SELECT x.*, row_number() OVER (PARTITION BY q, plan ORDER BY met DESC, episode, turn, kind DESC) AS rnk FROM pooled x) y WHERE n <= n_turns OR rnk <= n_turns", keep=True),
    Step("context_terms", f"SELECT q, {content('context')} AS words FROM base_context"),
    Step(
        "judged",
        """SELECT t.q, t.plan, t.family, CASE WHEN {size(a.long_terms)} > 0 AND coalesce({common({distinct(w.words)};a.long_terms)}, 0) < least(2, {size(a.long_terms)}) THEN 1 ELSE 0 END AS no_subject, CASE WHEN t.family = 'temporal' AND coalesce(c.timed, 0) = 0 THEN 1 ELSE 0 END AS no_time,
            CASE WHEN (a.dataset = 'longdialqa' OR t.family = 'longdialogue') AND a.asker <> '' AND coalesce(s.asked_for, 0) = 0 AND coalesce(s.speakers, 0) < 2 THEN 1 ELSE 0 END AS no_speaker, coalesce(p.conflicts, 0) AS conflicts, CASE WHEN b.q IS NULL AND s.q IS NULL THEN 1 ELSE 0 END AS no_context, CASE WHEN s.q IS NULL THEN 0 ELSE 1 END AS has_turns
        FROM task t JOIN asked a ON a.q = t.q LEFT JOIN context_terms w ON w.q = t.q LEFT JOIN base_context b ON b.q = t.q
        LEFT JOIN (SELECT h.q, h.plan, max(CASE WHEN c.time_expr <> '' OR c.event_time <> '' THEN 1 ELSE 0 END) AS timed FROM chosen h JOIN task k ON k.q = h.q AND k.plan = h.plan JOIN component c ON c.scope = k.scope AND c.episode = h.episode AND c.nth_ = h.nth_ GROUP BY h.q, h.plan) c ON c.q = t.q AND c.plan = t.plan
        LEFT JOIN (SELECT s.q, s.plan, count(DISTINCT CASE WHEN s.speaker <> '' THEN s.speaker END) AS speakers, max(CASE WHEN s.speaker = a.asker THEN 1 ELSE 0 END) AS asked_for FROM shown_turn s JOIN asked a ON a.q = s.q GROUP BY s.q, s.plan) s ON s.q = t.q AND s.plan = t.plan
        LEFT JOIN (SELECT q, plan, max(CASE WHEN edge_type = 'conflict_with' THEN 1 ELSE 0 END) AS conflicts FROM path GROUP BY q, plan) p ON p.q = t.q AND p.plan = t.plan""",
    ),
    Step(
        "sufficiency",
        """SELECT q, plan, no_subject + no_time + no_speaker + conflicts + no_context = 0 AS sufficient,
            CASE WHEN conflicts = 1 THEN 'CONFLICTED' WHEN no_context = 1 THEN 'ABSENT' WHEN no_time = 1 AND has_turns = 1 THEN 'INFERABLE' WHEN no_subject + no_time + no_speaker > 0 THEN 'UNDER-SPECIFIED' ELSE 'SUPPORTED' END AS status,
            concat_ws(',', CASE WHEN conflicts = 1 THEN 'conflicting_evidence' END, CASE WHEN no_context = 1 THEN 'missing_episode_context' END, CASE WHEN no_speaker = 1 THEN 'missing_speaker' END, CASE WHEN no_subject = 1 THEN 'missing_subject' END, CASE WHEN no_time = 1 THEN 'missing_time' END) AS missing FROM judged""",
        keep=True,
    ),
)

PLAN_LINE = f"""'. [component=' || c.component_id || ' ; score=' || {fixed3('h.shown_score')} || ' ; source_turns=D' || c.episode || ':' || c.turn || ' ; relation=' || c.relation
    || coalesce(' ; time=' || coalesce(nullif(c.event_time, ''), nullif(c.time_expr, ''), {{long_date(c.said_on)}}), '')
    || CASE WHEN c.subject <> '' OR c.predicate <> '' OR c.object_ <> '' THEN ' ; triple=' || coalesce(nullif(c.subject, ''), '?') || '|' || coalesce(nullif(c.predicate, ''), '?') || '|' || coalesce(nullif(c.object_, ''), '?') ELSE '' END
    || '] ' || {{short(c.text;240)}}"""
FIXED = {
    # The lines of a context that don't depend on the question.
    "graph": ("### Graph-Walk Evidence Plan", "Use this structured plan before the fallback context. Answer from source turns when the plan and fallback disagree."),
    "slot": ("### Answer-Slot Evidence Tree", "Use this tree to answer multi-hop questions. Prefer terminal answer candidates over broad neighboring facts."),
    "frame": ("### Universal Evidence Frame", "Use this frame to answer the question from concrete terminal evidence, not from broad neighboring facts."),
    "order-temporal": ("- Reasoning order: identify the event anchor, align it to dated source turns, then answer with the best-supported date or duration.",),
    "order-multi-hop": ("- Reasoning order: connect anchor facts through bridge paths, then fill the requested answer slot from the terminal evidence.",),
    "order-slot": ("- Reasoning order: root anchor facts -> bridge paths -> terminal answer candidates -> verified source turns.",),
    "order-frame": ("- Constraints: prefer terminal candidates with explicit answer objects; ignore pronoun-only candidates unless source turns resolve them; include all supported items for set answers.",),
}
#: Titles of a context's parts and how many rows of each are shown, by plan.
PARTS = {
    "graph-temporal": ("### Anchor Evidence Components", 10, "", 0, "### Graph Walk Bridge Paths", 8, "### Timeline Source Turns", 12, 320, 6000),
    "graph-multi-hop": ("### Anchor Evidence Components", 10, "", 0, "### Graph Walk Bridge Paths", 8, "### Bridge Source Turns", 12, 320, 6000),
    "slot": ("### Root Anchor Facts", 6, "### Terminal Answer Candidates", 6, "### Constrained Bridge Paths", 6, "### Verified Source Turns", 10, 300, 5000),
    "frame": ("### Frame Root Evidence", 6, "### Terminal Answer Candidates", 10, "### Minimal Bridge Paths", 6, "### Verified Source Turns", 12, 340, 5000),
}
TITLES = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in (plan, *row)) + ")" for plan, row in PARTS.items()) + ") AS v(plan, roots_title, n_roots, ends_title, n_ends, paths_title, n_paths, turns_title, n_lines, line_size, base_size)"


def fixed_line(name: str) -> str:
    return "(" + " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in FIXED[name]) + ")"


HEAD = f"""CASE WHEN t.plan LIKE 'graph%' THEN {fixed_line('graph')} || chr(10) || '- Question family: ' || t.family || chr(10) || '- Expected answer slot: ' || a.slot || chr(10) || '- Key terms: ' || coalesce(replace(k.line, ',', ', '), '') || chr(10) || CASE WHEN t.family = 'temporal' THEN {fixed_line('order-temporal')} ELSE {fixed_line('order-multi-hop')} END
    WHEN t.plan = 'slot' THEN {fixed_line('slot')} || chr(10) || '- Expected answer slot: ' || a.slot || chr(10) || '- Anchor terms: ' || coalesce(replace(n.line, ',', ', '), '') || chr(10) || {fixed_line('order-slot')}
    ELSE {fixed_line('frame')} || chr(10) || '- Answer slot: ' || a.slot || chr(10) || '- Intents: ' || replace(a.intents, ',', ', ') || chr(10) || '- Anchor terms: ' || coalesce(replace(n.line, ',', ', '), '') || chr(10) || {fixed_line('order-frame')} END"""
CONTEXT = (
    Step("titled", TITLES),
    Step("key_term", f"SELECT q, tok, row_number() OVER (PARTITION BY q ORDER BY min(pos)) AS rnk FROM (SELECT q, {content('text')} AS toks FROM framed) f {{posexplode(toks)}} GROUP BY q, tok"),
    Step("key_line", "SELECT q, {joined({collect(tok;rnk)};,)} AS line FROM key_term WHERE rnk <= 12 GROUP BY q"),
    Step("anchor_line", "SELECT q, {joined({collect(tok;rnk)};,)} AS line FROM anchor_term GROUP BY q"),
    Step("fact", "SELECT q, plan, episode, nth_, 1 AS part_, nth_choice AS at_, CAST(0 AS double) AS shown_score, '' AS label FROM anchor UNION ALL SELECT q, plan, episode, nth_, 1 AS part_, rnk AS at_, score AS shown_score, '' AS label FROM walk_anchor UNION ALL SELECT q, plan, episode, nth_, 2 AS part_, nth_choice AS at_, CASE WHEN plan = 'slot' THEN slot_bonus ELSE answer END AS shown_score, CASE WHEN plan = 'frame' THEN label ELSE '' END AS label FROM terminal"),
    Step("fact_line", f"SELECT h.q, h.plan, h.part_, h.at_, h.at_ || {PLAN_LINE} || CASE WHEN h.label <> '' THEN '; candidate=' || h.label ELSE '' END AS line FROM fact h JOIN task k ON k.q = h.q AND k.plan = h.plan JOIN titled v ON v.plan = h.plan JOIN component c ON c.scope = k.scope AND c.episode = h.episode AND c.nth_ = h.nth_ WHERE h.at_ <= CASE WHEN h.part_ = 1 THEN v.n_roots ELSE v.n_ends END"),
    Step("path_line", f"SELECT p.q, p.plan, 3 AS part_, p.rnk AS at_, p.rnk || '. [' || p.edge_type || '; score=' || {fixed3('p.score')} || CASE WHEN p.plan LIKE 'graph%' THEN '; source_turns=D' || p.episode || ':' || least(p.left_turn, p.right_turn) || CASE WHEN p.left_turn <> p.right_turn THEN ',D' || p.episode || ':' || greatest(p.left_turn, p.right_turn) ELSE '' END || '] ' || {{short(p.left_text;180)}} || ' => ' || {{short(p.right_text;180)}} ELSE '] ' || {{short(p.left_text;170)}} || ' => ' || {{short(p.right_text;170)}} END AS line FROM path p JOIN titled v ON v.plan = p.plan WHERE p.rnk <= v.n_paths"),
    Step("dated", "SELECT h.q, h.plan, h.place, c.episode, c.turn, c.text, coalesce(nullif(c.event_time, ''), nullif(c.time_expr, ''), {long_date(c.said_on)}) AS day, row_number() OVER (PARTITION BY h.q, h.plan ORDER BY h.place) AS at_ FROM chosen h JOIN task k ON k.q = h.q AND k.plan = h.plan JOIN component c ON c.scope = k.scope AND c.episode = h.episode AND c.nth_ = h.nth_ WHERE h.plan = 'graph-temporal' AND (c.time_expr <> '' OR c.said_on IS NOT NULL)"),
    Step("dated_line", "SELECT q, plan, 4 AS part_, at_, at_ || '. [' || day || '; source_turns=D' || episode || ':' || turn || '] ' || text AS line FROM dated WHERE at_ <= 8"),
    Step("turn_text", "SELECT s.q, s.plan, 5 AS part_, s.at_, {short({squeeze(s.shown)};v.line_size)} AS line FROM shown_turn s JOIN titled v ON v.plan = s.plan WHERE s.at_ <= v.n_lines"),
    Step("base_text", "SELECT t.q, t.plan, 6 AS part_, 1 AS at_, {short({squeeze(b.context)};v.base_size)} AS line FROM task t JOIN base_context b ON b.q = t.q JOIN titled v ON v.plan = t.plan"),
    Step("body", "SELECT * FROM fact_line UNION ALL SELECT * FROM path_line UNION ALL SELECT * FROM dated_line UNION ALL SELECT * FROM turn_text UNION ALL SELECT * FROM base_text"),
    Step("section", "SELECT q, plan, part_, {joined_lines({collect(line;at_)})} AS lines FROM body GROUP BY q, plan, part_"),
    Step("part_text", "SELECT p.q, p.plan, p.part_, chr(10) || CASE p.part_ WHEN 1 THEN v.roots_title WHEN 2 THEN v.ends_title WHEN 3 THEN v.paths_title WHEN 4 THEN '### Candidate Timeline Anchors' WHEN 5 THEN v.turns_title ELSE '### Baseline Fallback Context' END || chr(10) || p.lines AS lines FROM section p JOIN titled v ON v.plan = p.plan"),
    Step("headed", f"SELECT t.q, t.plan, 0 AS part_, {HEAD} AS lines FROM task t JOIN asked a ON a.q = t.q LEFT JOIN key_line k ON k.q = t.q LEFT JOIN anchor_line n ON n.q = t.q"),
    Step("planned", "SELECT q, plan, {joined_lines({collect(lines;part_)})} AS context FROM (SELECT * FROM headed UNION ALL SELECT * FROM part_text) x GROUP BY q, plan", keep=True),
    Step("route", """SELECT a.q, m.method, a.family, CASE WHEN a.family = 'temporal' THEN 'graph-temporal' WHEN a.family = 'multi-hop' THEN m.plan END AS plan FROM asked a CROSS JOIN (SELECT * FROM (VALUES ('graph_walk_plan_routing', 'graph-multi-hop'), ('answer_slot_tree_routing', 'slot'), ('evidence_frame_routing', 'frame')) AS v(method, plan)) m"""),
    Step("answer_context", """SELECT r.q, r.method, r.family, CASE r.plan WHEN 'slot' THEN 'answer_slot_constrained_tree' WHEN 'frame' THEN 'answer_frame_terminal_coverage' ELSE CASE WHEN r.plan IS NULL THEN 'baseline_passthrough' ELSE 'graph_walk_evidence_plan' END END AS route_name,
            CASE WHEN r.plan IS NULL THEN 'low' WHEN r.plan = 'graph-temporal' THEN 'high' ELSE 'medium' END AS risk, coalesce(s.status, 'SUPPORTED') AS status, coalesce(s.missing, '') AS missing, coalesce(p.context, b.context, '') AS context
        FROM route r LEFT JOIN planned p ON p.q = r.q AND p.plan = r.plan LEFT JOIN sufficiency s ON s.q = r.q AND s.plan = r.plan LEFT JOIN base_context b ON b.q = r.q"""),
)

SEARCH_ALL = (Step("any_edge", "SELECT f.q, '' AS plan, 10 AS n_edges, e.scope, e.episode, e.l, e.r, e.source, e.edge_type, e.relation_text, e.made FROM framed f JOIN edge e ON e.scope = f.scope"), *edge_search("all", "any_edge"))
OVER_STORE = (*ASKED, *SEARCH, *TURNS, TASK, *SCORED, *CHOICES, *REPAIR, *CONTEXT)
STEPS = of_asked((*STORE, *OVER_STORE))
OF_TABLES = (TURN, QUESTION, *of_asked((*STORE, *ASKED, *SEARCH, BASE, *TURNS, TASK, *SCORED, *CHOICES, *REPAIR, *CONTEXT, *SEARCH_ALL)))
#: What a call of ``retrieve`` gives: one table per trace.
TRACES = {
    "context": "SELECT q, method, family, route_name, risk, status, missing, context FROM answer_context WHERE method = '$method'",
    "components": "SELECT h.q, h.plan, h.place, h.role, h.score, h.episode, c.turn, h.nth_, c.component_id, c.text FROM chosen h JOIN route r ON r.q = h.q AND r.plan = h.plan JOIN task k ON k.q = h.q AND k.plan = h.plan JOIN component c ON c.scope = k.scope AND c.episode = h.episode AND c.nth_ = h.nth_ WHERE r.method = '$method'",
    "paths": "SELECT p.q, p.plan, p.rnk, p.score, p.edge_type, p.relation_text, p.episode, p.l, p.r FROM path p JOIN route r ON r.q = p.q AND r.plan = p.plan WHERE r.method = '$method'",
    "turns": "SELECT s.q, s.plan, s.at_, s.kind, s.episode, s.turn, s.shown FROM shown_turn s JOIN route r ON r.q = s.q AND r.plan = s.plan WHERE r.method = '$method'",
}


def retrieve(turns: DataFrame, questions: DataFrame, base: DataFrame, method: str, max_chars: int = 60000) -> dict[str, DataFrame]:
    """The traces of a method for all questions: context, components, paths, turns.

    ``turns``: scope, episode, turn, speaker, text, said_on. ``questions``: q, scope, text,
    question_type, hop_type, answerability, dataset, asker. ``base``: q, episode, turn.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    spark = turns.sparkSession
    sources = {"turn_": turns, "question_": questions, "base_": base}
    out = run_steps(spark, STEPS, sources, {name: text.replace("$method", method) for name, text in TRACES.items()})
    out["context"] = out["context"].selectExpr("q", "method", "family", "route_name", "risk", "status", "missing", f"substring(context, 1, {max_chars}) AS context", f"length(context) > {max_chars} AS truncated")
    return out


RELATION_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}')" for f, rs in RELATIONS.items() for r in rs) + ") AS v(family, relation)"
QUERIES = [
    Plan("o201_search_components", OF_TABLES, "SELECT q, episode, nth_, score, rnk FROM best_hit WHERE variant = 'plain' AND rnk <= 10"),
    Plan("o202_search_edges", OF_TABLES, "SELECT q, episode, l, r, source, edge_type, score, rnk FROM all_found"),
    Plan("o315_route", OF_TABLES, f"SELECT f.q, f.family, b.risk, b.components, b.edges, b.episodes FROM framed f JOIN (SELECT * FROM {BUDGETS} AS v(family, risk, components, edges, episodes)) b ON b.family = f.family"),
    Plan("o436_edges_of_family", OF_TABLES, f"SELECT f.q, f.family, CAST(sum(CASE f.family WHEN 'temporal' THEN CASE WHEN e.edge_type IN ({listed(WALK_TYPES['temporal'])}) THEN e.n ELSE 0 END WHEN 'multi-hop' THEN CASE WHEN e.edge_type IN ({listed(WALK_TYPES['multi-hop'])}) THEN e.n ELSE 0 END ELSE e.n END) AS bigint) AS edges FROM framed f JOIN (SELECT scope, edge_type, count(*) AS n FROM edge GROUP BY scope, edge_type) e ON e.scope = f.scope GROUP BY f.q, f.family"),
    Plan("o206_turns_for_question", OF_TABLES, "SELECT q, plan, episode, turn, kind, met, n FROM pooled"),
    Plan("o207_repaired_turns", OF_TABLES, "SELECT q, plan, episode, idx, kind FROM pool"),
    Plan("o208_frame_scores", OF_TABLES, "SELECT q, episode, nth_, total, place FROM scored_component WHERE plan = 'frame'"),
    Plan("o209_slot_tree_scores", OF_TABLES, "SELECT q, episode, nth_, total, place FROM scored_component WHERE plan = 'slot'"),
    Plan("o210_frame_roots", OF_TABLES, "SELECT q, episode, nth_, nth_choice FROM anchor WHERE plan = 'frame'"),
    Plan("o211_frame_terminals", OF_TABLES, "SELECT q, episode, nth_, nth_choice, label FROM terminal WHERE plan = 'frame'"),
    Plan("o212_slot_terminals", OF_TABLES, "SELECT q, episode, nth_, nth_choice, slot_bonus FROM terminal WHERE plan = 'slot'"),
    Plan("o126_walked_edges", OF_TABLES, "SELECT q, plan, episode, l, r, edge_type, score, rnk FROM path WHERE plan LIKE 'graph%'"),
    Plan("o127_slot_tree_bridges", OF_TABLES, "SELECT q, plan, episode, l, r, edge_type, score, rnk FROM path WHERE plan IN ('slot', 'frame')"),
    Plan("o302_question_family", (TURN_QUESTION, *ASKED), "SELECT conv_id, turn, family FROM framed JOIN conversations ON q = conv_id * 1000000 + turn"),
    Plan("o302_question_families", OF_TABLES, "SELECT q, family FROM framed"),
    Plan("o303_anchor_terms", OF_TABLES, "SELECT q, tok, rnk FROM anchor_term"),
    Plan("o305_question_frames", OF_TABLES, "SELECT q, slot, family, intents, frame_query FROM framed"),
    Plan("o306_slot_queries", OF_TABLES, "SELECT q, slot_query FROM framed"),
    Plan("o307_answer_bonuses", OF_TABLES, "SELECT q, plan, episode, nth_, round(slot_bonus, 6) AS slot_bonus, round(preferred, 6) AS preferred, round(habit, 6) AS habit, round(set_bonus, 6) AS set_bonus, round(penalty, 6) AS penalty, round(answer, 6) AS answer FROM scored_component"),
    Plan("o313_answer_labels", OF_TABLES, "SELECT q, episode, nth_, label FROM scored_component WHERE plan = 'frame'"),
    Plan("o314_sufficiency", OF_TABLES, "SELECT q, plan, sufficient, status, missing FROM sufficiency"),
    Plan("o435_relations_of_family", OF_TABLES, f"SELECT f.q, f.family, count(v.relation) AS relations FROM framed f LEFT JOIN ({RELATION_ROWS}) v ON v.family = f.family GROUP BY f.q, f.family"),
    Plan("o438_base_turns", OF_TABLES, "SELECT q, episode, turn FROM base_"),
    Plan("o439_components_from_walk", OF_TABLES, "SELECT q, plan, episode, nth_, role, place FROM chosen WHERE plan LIKE 'graph%'"),
    Plan("o431_routed_contexts", OF_TABLES, "SELECT q, method, family, route_name, risk, status, missing, {sha256(context)} AS context_sha256, length(context) AS context_size FROM answer_context"),
    Plan("o432_graph_walk_plans", OF_TABLES, TRACES["context"].replace("$method", METHODS[0])),
    Plan("o433_slot_tree_plans", OF_TABLES, TRACES["context"].replace("$method", METHODS[1])),
    Plan("o434_frame_plans", OF_TABLES, TRACES["context"].replace("$method", METHODS[2])),
]
