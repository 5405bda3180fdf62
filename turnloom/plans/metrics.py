"""Scores of an answer against its reference, each with its own tokens: sets, bags, clipped unigrams, longest common subsequence.

A null text counts as empty. Chinese, Japanese and Korean have no spaces, so a chunk that
holds such a character becomes one token a character.
"""

from turnloom.sql import Query

PAIRS = "pair AS (SELECT u.conv_id, u.turn, u.text AS gold_text, a.text AS said_text FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
PLAIN = "{without({by_character({split_ws({no_punctuation($)})})};'a', 'an', 'the')}"
ASCII = "{fields({no_ascii_punctuation({no_words(lower(replace(coalesce($, ''), ',', ''));a|an|the|and)})})}"
#: A text without ASCII punctuation and articles; ``{metric_fields(x)}`` cuts it into tokens.
METRIC = "{no_words({ascii_spaced($)};a|an|the)}"
ANSWER = "{fields({no_words({no_punctuation($)};a|an|the)})}"
SIMPLE = "{split_ws(translate(lower(coalesce($, '')), '.,!?', '    '))}"
SPACES = "{split_ws(lower(coalesce($, '')))}"
QUOTED = "{apostrophe_words($)}"


def tokens(kind):
    return f"{PAIRS}, t AS (SELECT conv_id, turn, {kind.replace('$', 'gold_text')} AS gold, {kind.replace('$', 'said_text')} AS said FROM pair)"


def metric_pairs():
    """Turns and the answers that follow them, cut by the rule of ``METRIC``."""
    normal = f"n AS (SELECT conv_id, turn, {METRIC.replace('$', 'gold_text')} AS gold_norm, {METRIC.replace('$', 'said_text')} AS said_norm FROM pair)"
    return f"{PAIRS}, {normal}, t AS (SELECT conv_id, turn, {{metric_fields(gold_norm)}} AS gold, {{metric_fields(said_norm)}} AS said FROM n)"


def bag(kind):
    """Adds ``m``, the size of the bag that both share."""
    return f"""{tokens(kind)},
        g AS (SELECT conv_id, turn, tok, count(*) AS n FROM t {{explode(gold)}} GROUP BY conv_id, turn, tok),
        s AS (SELECT conv_id, turn, tok, count(*) AS n FROM t {{explode(said)}} GROUP BY conv_id, turn, tok),
        shared AS (SELECT g.conv_id, g.turn, sum(least(g.n, s.n)) AS m FROM g JOIN s ON g.conv_id = s.conv_id AND g.turn = s.turn AND g.tok = s.tok GROUP BY g.conv_id, g.turn),
        b AS (SELECT t.conv_id, t.turn, CAST({{size(gold)}} AS double) AS ng, CAST({{size(said)}} AS double) AS ns, CAST(coalesce(m, 0) AS double) AS m FROM t LEFT JOIN shared x ON t.conv_id = x.conv_id AND t.turn = x.turn)"""


SET_F1 = "CASE WHEN {size(gold)} = 0 OR {size(said)} = 0 THEN 0.0 ELSE CAST(2 * {common(gold;said)} AS double) / ({size({distinct(gold)})} + {size({distinct(said)})}) END"

QUERIES = [
    Query("o273_simple_tokens", f"SELECT conv_id, turn, {{joined({PLAIN.replace('$', 'text')}; )}} AS tokens_ FROM conversations"),
    Query("o274_answer_set_f1", f"WITH {tokens(PLAIN)} SELECT conv_id, turn, {SET_F1} AS f1 FROM t"),
    Query("o275_smoothed_bleu1", f"""
        WITH {bag(PLAIN)}
        SELECT conv_id, turn, CASE WHEN m = 0 THEN 0.0 ELSE m / ns * CASE WHEN ns > ng THEN 1.0 ELSE exp(1 - ng / ns) END END AS bleu1 FROM b"""),
    Query("o277_metric_tokens", f"WITH n AS (SELECT doc_id, {METRIC.replace('$', 'text')} AS norm FROM documents), t AS (SELECT doc_id, {{metric_fields(norm)}} AS toks FROM n) SELECT doc_id, {{size(toks)}} AS n, {{sha256({{joined(toks; )}})}} AS tokens_sha FROM t"),
    Query("o278_set_f1", f"WITH {metric_pairs()} SELECT conv_id, turn, CAST({{common(gold;said)}} AS bigint) AS shared, {SET_F1} AS f1 FROM t"),
    Query("o280_bag_f1", f"WITH {bag(QUOTED)} SELECT conv_id, turn, CAST(m AS bigint) AS shared, CASE WHEN ng = 0 AND ns = 0 THEN 1.0 WHEN m = 0 THEN 0.0 ELSE 2 * m / (ng + ns) END AS f1 FROM b"),
    Query("o283_bleu1", f"WITH {bag(QUOTED)} SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0.0 ELSE m / ns * CASE WHEN ns > ng THEN 1.0 ELSE power(CAST(2.718281828 AS double), 1 - ng / ns) END END, 9) AS bleu1 FROM b"),
    Query("o282_bag_f1_of_quoted_words", f"""
        WITH {bag(QUOTED)}
        SELECT conv_id, turn, CASE WHEN ng = 0 AND ns = 0 THEN 1.0 WHEN m = 0 THEN 0.0 ELSE 2 * m / (ng + ns) END AS f1 FROM b"""),
    Query("o286_normalised_answer", f"SELECT conv_id, turn, {{joined({ASCII.replace('$', 'text')}; )}} AS answer FROM conversations"),
    Query("o290_tokens_without_stops", f"SELECT conv_id, turn, {{size({SIMPLE.replace('$', 'text')})}} AS n, {{joined({SIMPLE.replace('$', 'text')}; )}} AS tokens_ FROM conversations"),
    Query("o177_mean_set_f1", f"WITH {tokens(SPACES)} SELECT count(*) AS n, round(avg({SET_F1}), 9) AS mean_f1 FROM t WHERE {{size(gold)}} > 0"),
    Query("o175_mean_reciprocal_rank", """
        WITH r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rnk FROM conversations),
        best AS (SELECT conv_id, min(CASE WHEN role = 'assistant' THEN rnk END) AS first_hit FROM r GROUP BY conv_id)
        SELECT count(*) AS n, round(avg(coalesce(1e0 / first_hit, 0)), 9) AS mrr FROM best"""),
]
