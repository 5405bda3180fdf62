"""Tokens, sentences, entities, answers and keys as scalars, applied to whole tables."""

from turnloom.plans.evidence import CAUSAL, CONTENT, PREFERENCE, SENTENCES, SOCIAL, STOP, TEMPORAL, marked
from turnloom.plans.metrics import ANSWER
from turnloom.sql import Query

NAMES = f"{{named({{all_entity({{blank_letter_beyond_ascii(text)}})}};{STOP})}}"

QUERIES = [
    Query("o264_tokens", "SELECT doc_id, {size({tokens(text)})} AS n, {joined({tokens(text)}; )} AS all_tokens FROM documents"),
    Query("o265_content_tokens", f"SELECT conv_id, turn, count(*) AS n, count(DISTINCT tok) AS kinds FROM conversations {{explode({{tokens(text)}})}} WHERE {CONTENT} GROUP BY conv_id, turn"),
    Query("o266_lexical_score", """
        WITH w AS (SELECT conv_id, turn, role, tok, count(*) AS n FROM conversations {explode({tokens(text)})} GROUP BY conv_id, turn, role, tok)
        SELECT q.conv_id, q.turn, round(CAST(sum(least(q.n, coalesce(a.n, 0))) AS double) / sum(q.n) + CAST(0.05 AS double) * sum(CASE WHEN length(q.tok) >= 5 AND contains(lower(c.text), q.tok) THEN 1 ELSE 0 END), 6) AS score
        FROM w q LEFT JOIN w a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.tok = q.tok LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1
        WHERE q.role = 'user' GROUP BY q.conv_id, q.turn"""),
    Query("o267_sentences", f"SELECT item_id, pos, trim(tok) AS sentence FROM (SELECT item_id, {{cut({SENTENCES})}} AS parts FROM benchmark) b {{posexplode(parts)}} WHERE trim(tok) <> ''"),
    Query("o268_entities", f"""
        WITH e AS (SELECT doc_id, tok, min(pos) AS first_pos FROM (SELECT doc_id, tok, pos FROM (SELECT doc_id, {NAMES} AS names_ FROM documents) d {{posexplode(names_)}}) x GROUP BY doc_id, tok)
        SELECT doc_id, tok AS entity, first_pos FROM (SELECT doc_id, tok, first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS rnk FROM e) w WHERE rnk <= 8"""),
    Query("o269_relation_type", f"""
        WITH t AS (SELECT conv_id, turn, {{without({{tokens(coalesce(text, ''))}};{STOP})}} AS toks, {NAMES} AS names_ FROM conversations)
        SELECT conv_id, turn, CASE WHEN {marked(TEMPORAL)} THEN 'temporal' WHEN {marked(CAUSAL)} THEN 'causal' WHEN {marked(PREFERENCE)} THEN 'preference/attribute' WHEN {marked(SOCIAL)} THEN 'social'
               WHEN {{size({{distinct(names_)}})}} >= 2 THEN 'entity' ELSE 'event-update' END AS relation FROM t"""),
    Query("o271_stable_id", "SELECT event_id, concat('event_', substr({sha1(concat_ws('||', CAST(user_id AS varchar(20)), event_type, CAST(event_id AS varchar(20))))}, 1, 12)) AS stable_id FROM events"),
    Query("o272_normalised_answer", f"SELECT conv_id, turn, {{joined({ANSWER.replace('$', 'text')}; )}} AS answer FROM conversations"),
    Query("o279_refusal", "SELECT conv_id, turn, contains(lower(text), 'cannot') OR contains(lower(text), 'not mentioned') OR contains(lower(text), 'no information') OR contains(lower(text), 'sorry') AS refused FROM conversations WHERE role = 'assistant'"),
    Query("o281_one_option", f"""
        WITH o AS (SELECT doc_id, upper(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, {" || ".join(f"CASE WHEN contains(t, '({c})') THEN '{c}' ELSE '' END" for c in "ABCDE")} AS found FROM o)
        SELECT doc_id, CASE WHEN found = '' THEN 'none' WHEN length(found) > 1 THEN 'ambiguous' ELSE found END AS picked_option FROM c"""),
    Query("o333_time_expression", "SELECT doc_id, CASE WHEN contains(lower(text), 'yesterday') THEN 'yesterday' WHEN contains(lower(text), 'tomorrow') THEN 'tomorrow' WHEN contains(lower(text), 'last week') THEN 'last week' ELSE regexp_extract(lower(text), '(monday|tuesday|wednesday|thursday|friday|saturday|sunday|[0-9][0-9]:[0-9][0-9])', 0) END AS expression FROM documents"),
    Query("o334_relative_dates", "SELECT event_id, event_type, CAST({epoch(date_trunc('day', ts))} AS bigint) + CASE event_type WHEN 'view' THEN -86400 WHEN 'click' THEN 86400 WHEN 'purchase' THEN -604800 ELSE 0 END AS day_s FROM events"),
    Query("o356_binary_response", "SELECT conv_id, turn, CASE WHEN {matches(lower(text);(wrong|incorrect))} THEN 0 WHEN {matches(lower(text);(correct|yes))} THEN 1 END AS verdict FROM conversations"),
    Query("o357_first_number", "SELECT doc_id, least(greatest(try_cast(regexp_extract(text, '[0-9]+([.][0-9]+)?', 0) AS double), 0), 1) AS score FROM documents"),
    Query("o358_record_key", "SELECT o_orderkey, {sha256(concat('[', CAST(o_custkey AS varchar(20)), ',', CAST(o_orderkey AS varchar(20)), ',', o_orderstatus, ']'))} AS record_key FROM orders"),
    Query("o367_joined_fields", "SELECT doc_id, concat_ws(' | ', source, lang, CAST(n_chars AS varchar(20))) AS line FROM documents"),
]
