"""Turn tables: script text to turns, session order, first and last turns, batches, supersession, audits and merged edits."""

from turnloom.sql import Query

CONTENTFUL = "c AS (SELECT conv_id, turn, role, trim({squeeze(text)}) AS text FROM conversations WHERE trim({squeeze(text)}) <> '')"


def numbered(table: str, group: str, key: str, columns: str) -> str:
    """``numbered``: rows of a group numbered by an integer key, block by block, so that a group is never sorted in one task."""
    return f"""
        b_ AS (SELECT {columns}, {group} AS g_, {key} AS k_, CAST(floor({key} / 4096.0) AS bigint) AS blk FROM {table}),
        ahead AS (SELECT g_, blk, coalesce(sum(n) OVER (PARTITION BY g_ ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM (SELECT g_, blk, count(*) AS n FROM b_ GROUP BY g_, blk) s),
        numbered AS (SELECT b.*, CAST(a.before_ + row_number() OVER (PARTITION BY b.g_, b.blk ORDER BY b.k_) AS bigint) AS num FROM b_ b JOIN ahead a ON a.g_ = b.g_ AND a.blk = b.blk)"""


QUERIES = [
    # A conversation's turns, written as "role: text", are the script; a line with a colon opens a turn, others carry it on.
    Query("o010_parse_turns", """
        WITH l AS (SELECT conv_id, turn, pos, tok AS raw, trim(tok) AS line FROM (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS said FROM conversations) s {posexplode({lines(said)})} WHERE trim(tok) <> '' AND position('Teleplay: ' IN tok) = 0 AND position('Story: ' IN tok) = 0),
        m AS (SELECT conv_id, turn, pos, line, sum(CASE WHEN position(':' IN raw) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_ FROM l),
        w AS (SELECT conv_id, turn_, count(*) AS lines_, {joined_lines({collect(line;turn * 10000 + pos)})} AS raw FROM m WHERE turn_ > 0 GROUP BY conv_id, turn_)
        SELECT conv_id, CAST(turn_ AS bigint) AS turn_, lines_, trim(substr(raw, 1, position(':' IN raw) - 1)) AS speaker, trim(substr(raw, position(':' IN raw) + 1)) AS utterance FROM w"""),
    Query("o011_sessions_in_order", "SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS ordinal FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 50) s"),
    Query("o016_session_lines", "SELECT conv_id, {joined({collect(concat(role, ': ', coalesce(text, ''));turn)}; )} AS session_ FROM conversations GROUP BY conv_id"),
    Query("o018_turns_with_place", "SELECT conv_id, turn, CAST(floor(turn / 4.0) AS bigint) AS session_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations"),
    Query("o019_flat_turns", f"WITH {CONTENTFUL} SELECT conv_id, turn, role, substr(text, 1, 240) AS text FROM c"),
    Query("o020_numeric_key_order", "WITH k AS (SELECT DISTINCT user_id, CAST(floor({epoch(ts)} / 86400.0) AS bigint) - 19000 AS d FROM events), n AS (SELECT user_id, concat('session_', CAST(d AS varchar(20))) AS key_ FROM k) SELECT user_id, key_, row_number() OVER (PARTITION BY user_id ORDER BY CAST(regexp_extract(key_, '[0-9]+', 0) AS int)) AS place FROM n"),
    Query("o022_record_by_name", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000007'"),
    Query("o036_last_row_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS back FROM events e) w WHERE back = 1"),
    Query("o043_audit_batches", f"WITH {numbered('documents', 'source', 'doc_id', 'doc_id, source')} SELECT source, doc_id, CAST(ceil(num / 50.0) AS bigint) AS batch FROM numbered"),
    Query("o059_superseded", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS superseded_by, {epoch(lead(o_orderdate) OVER w)} AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    Query("o062_insert_or_ignore", """
        WITH kept AS (SELECT DISTINCT conv_id AS id FROM conversations), new_ AS (SELECT DISTINCT user_id AS id FROM events)
        SELECT id, 'kept' AS state FROM kept UNION ALL SELECT n.id, 'inserted' AS state FROM new_ n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = n.id)"""),
    Query("o063_status_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN {epoch(o_orderdate)} + 86400 END AS ended_s FROM orders"),
    Query("o111_trace_errors", """
        WITH j AS (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS extra, l.doc_id IS NULL AS missing, NOT d.n_chars <=> length(d.text) AS unequal, l.quality, l.toxic FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id),
        r AS (SELECT doc_id, 'extra' AS rule FROM j WHERE extra UNION ALL SELECT doc_id, 'missing' AS rule FROM j WHERE missing UNION ALL SELECT doc_id, 'field' AS rule FROM j WHERE NOT extra AND unequal
              UNION ALL SELECT doc_id, 'toxic_good' AS rule FROM j WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 'duplicate' AS rule FROM documents GROUP BY doc_id HAVING count(*) > 1)
        SELECT doc_id, rule FROM r""".replace("NOT d.n_chars <=> length(d.text)", "d.n_chars IS DISTINCT FROM length(d.text)")),
    Query("o117_expected_against_found", """
        WITH want AS (SELECT d.doc_id, coalesce(l.quality, 1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), found AS (SELECT doc_id, CASE WHEN n_chars < 40 THEN 0 ELSE 1 END AS quality FROM documents)
        SELECT 'not found' AS side, doc_id, quality FROM (SELECT doc_id, quality FROM want EXCEPT ALL SELECT doc_id, quality FROM found) a UNION ALL SELECT 'not expected' AS side, doc_id, quality FROM (SELECT doc_id, quality FROM found EXCEPT ALL SELECT doc_id, quality FROM want) b"""),
    Query("o118_merged_edits", """
        WITH edit AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 0 THEN 'low' END AS corrected FROM labels)
        SELECT coalesce(d.doc_id, e.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN e.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS state, CASE WHEN e.doc_id IS NULL THEN d.source ELSE nullif(coalesce(e.corrected, d.source), '') END AS source FROM documents d FULL OUTER JOIN edit e ON d.doc_id = e.doc_id"""),
    Query("o128_as_of_turns", """
        WITH t AS (SELECT conv_id % 7 AS show_, conv_id, turn, role, length(text) AS chars FROM conversations),
        s AS (SELECT show_, conv_id, count(*) AS n, sum(chars) AS chars FROM t GROUP BY show_, conv_id),
        earlier AS (SELECT conv_id, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(chars) OVER w, 0) AS chars FROM s WINDOW w AS (PARTITION BY show_ ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        own AS (SELECT conv_id, turn, role, count(*) OVER w AS n, sum(chars) OVER w AS chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT o.conv_id, o.turn AS ask_turn, CAST(e.n + o.n AS bigint) AS visible, CAST(e.chars + o.chars AS bigint) AS visible_chars FROM own o JOIN earlier e ON e.conv_id = o.conv_id WHERE o.role = 'user'"""),
    Query("o150_merged_shard_metrics", """
        WITH p AS (SELECT lang, doc_id % 8 AS shard, count(*) AS n, sum(n_chars) AS chars, max(n_chars) AS longest FROM documents GROUP BY lang, doc_id % 8)
        SELECT lang, CAST(sum(n) AS bigint) AS n, round(CAST(sum(chars) AS double) / sum(n), 6) AS mean_chars, max(longest) AS longest FROM p GROUP BY lang"""),
    Query("o160_recent_evidence", """
        WITH s AS (SELECT user_id, CAST(floor({epoch(ts)} / 86400.0) AS bigint) AS day_, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS cited FROM events GROUP BY user_id, CAST(floor({epoch(ts)} / 86400.0) AS bigint)),
        r AS (SELECT s.*, dense_rank() OVER (PARTITION BY user_id ORDER BY day_ DESC) AS back FROM s)
        SELECT user_id, max(CASE WHEN cited = 1 THEN back END) <= 1 AS in_last, max(CASE WHEN cited = 1 THEN back END) <= 3 AS in_last_three, sum(cited) > 1 AS across_sessions FROM r GROUP BY user_id"""),
    Query("o178_retrieval_metrics", """
        WITH r AS (SELECT conv_id, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rnk FROM conversations),
        q AS (SELECT conv_id, min(CASE WHEN role = 'assistant' THEN rnk END) AS first_hit, count(CASE WHEN role = 'assistant' AND rnk <= 5 THEN 1 END) AS hits, count(CASE WHEN role = 'assistant' THEN 1 END) AS relevant FROM r GROUP BY conv_id)
        SELECT count(*) AS n, round(avg(CASE WHEN first_hit <= 5 THEN 1e0 ELSE 0e0 END), 9) AS hit_rate, round(avg(coalesce(1e0 / first_hit, 0)), 9) AS mrr, round(avg(CASE WHEN relevant > 0 THEN CAST(hits AS double) / relevant END), 9) AS recall FROM q"""),
    Query("o195_entities_by_name", """
        WITH m AS (SELECT conv_id, turn, pos, tok AS name FROM conversations {posexplode({names(text)})})
        SELECT name_key, mentions, attribute, confidence FROM (
            SELECT lower(name) AS name_key, name AS attribute, count(*) OVER (PARTITION BY lower(name)) AS mentions, max(length(name)) OVER (PARTITION BY lower(name)) AS confidence, row_number() OVER (PARTITION BY lower(name) ORDER BY conv_id DESC, turn DESC, pos DESC) AS back FROM m) w WHERE back = 1"""),
    Query("o234_expansion_cost", "SELECT source, CAST(sum(floor(least(n_chars, 200) / 4.0) + floor(n_chars / 4.0) + CASE WHEN lang = 'en' THEN 200 ELSE 500 END) AS bigint) AS tokens_, count(CASE WHEN lang = 'en' THEN 1 END) AS audio, count(CASE WHEN lang <> 'en' THEN 1 END) AS other_ FROM documents GROUP BY source"),
    Query("o235_max_merge", """
        WITH hit AS (SELECT user_id AS id, max(value) AS score, 'click' AS via FROM events WHERE event_type = 'click' GROUP BY user_id UNION ALL SELECT user_id AS id, max(value) * 0.9e0 AS score, 'view' AS via FROM events WHERE event_type = 'view' GROUP BY user_id)
        SELECT id, score FROM (SELECT id, round(max(score), 6) AS score FROM hit GROUP BY id) m ORDER BY score DESC, id LIMIT 50"""),
    Query("o241_first_content_turns", f"WITH {CONTENTFUL} SELECT conv_id, turn, text FROM (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rnk FROM c) w WHERE rnk = 1"),
    Query("o242_last_content_turns", f"WITH {CONTENTFUL} SELECT conv_id, turn, text FROM (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rnk FROM c) w WHERE rnk = 1"),
    Query("o243_diverse_turns", """
        WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up_, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        c AS (SELECT conv_id, turn, 0 AS tier FROM p WHERE up_ = 1 OR up_ = n UNION ALL SELECT conv_id, turn, 1 AS tier FROM p WHERE (up_ - 1) % greatest(CAST(floor(n / 4.0) AS bigint), 1) = 0),
        d AS (SELECT conv_id, turn, min(tier) AS tier FROM c GROUP BY conv_id, turn)
        SELECT conv_id, turn, tier FROM (SELECT d.*, row_number() OVER (PARTITION BY conv_id ORDER BY tier, turn) AS rnk FROM d) w WHERE rnk <= 6"""),
    Query("o244_interleaved_lines", """
        WITH n AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY k, role DESC) AS place FROM n"""),
    Query("o245_order_errors", "SELECT conv_id, turn, prior FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prior_chars, length(text) AS chars FROM conversations) w WHERE turn <> coalesce(prior, -1) + 1 OR chars = prior_chars"),
    Query("o246_prediction_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS place FROM conversations"),
    Query("o247_next_todo", "SELECT d.source, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL ORDER BY d.source, d.doc_id LIMIT 25"),
    Query("o248_stratified_subset", """
        WITH k AS (SELECT doc_id, source, lang, sum(n) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rnk, count(*) OVER (PARTITION BY source, lang) AS n FROM (SELECT doc_id, source, lang, 1 AS n FROM documents) d),
        r AS (SELECT doc_id, 'first' AS reason FROM k WHERE rnk <= 2 UNION ALL SELECT doc_id, 'share' AS reason FROM k WHERE rnk <= ceil(0.3 * n) UNION ALL SELECT doc_id, 'toxic' AS reason FROM labels WHERE toxic = 1)
        SELECT doc_id, {joined({collect(reason;reason)};+)} AS reasons FROM (SELECT DISTINCT doc_id, reason FROM r) x GROUP BY doc_id"""),
    Query("o253_merged_lists", """
        WITH u AS (SELECT doc_id AS id, 0 AS list_ FROM labels WHERE quality = 1 UNION ALL SELECT doc_id AS id, 1 AS list_ FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id AS id, 2 AS list_ FROM documents WHERE n_chars > 500)
        SELECT id, min(list_) AS list_ FROM u GROUP BY id"""),
    Query("o458_entities_of_type", "SELECT s.s_suppkey, s.s_name, l.l_partkey, l.l_orderkey FROM (SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 ORDER BY s_suppkey LIMIT 10) s JOIN lineitem l ON l.l_suppkey = s.s_suppkey"),
    Query("o459_entities_of_unit", "SELECT item_id, tok AS entity, min(pos) AS first_pos FROM benchmark {posexplode({names(text)})} GROUP BY item_id, tok"),
    Query("o460_resolved_relations", """
        WITH r AS (SELECT conv_id, turn, lower({nth({names(text)};1)}) AS s, lower({nth({names(text)};2)}) AS o FROM conversations), node AS (SELECT lower(tok) AS name, min(item_id) AS id FROM benchmark {explode({names(text)})} GROUP BY lower(tok))
        SELECT r.conv_id, r.turn, a.id AS subject_id, b.id AS object_id FROM r JOIN node a ON a.name = r.s JOIN node b ON b.name = r.o"""),
    Query("o470_leaderboard", "SELECT 'quality' AS metric, source, round(avg(CAST(l.quality AS double)), 9) AS mean FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source UNION ALL SELECT 'toxic' AS metric, source, round(avg(CAST(l.toxic AS double)), 9) AS mean FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source UNION ALL SELECT 'chars' AS metric, source, round(avg(CAST(n_chars AS double)), 9) AS mean FROM documents GROUP BY source"),
    Query("o471_cached_or_fresh", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END) AS verdict, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0"),
]
