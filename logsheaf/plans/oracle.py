"""Independent SQL for the registered queries."""

from __future__ import annotations

# Named subqueries, each using only earlier ones.
PARTS = {
    "auth": """
        SELECT event_id AS line_no,
               CAST(epoch_us(ts) // 1000000 - 1704067200 AS BIGINT) AS time,
               'U' || user_id AS src_user, 'U' || k AS dst_user,
               'C' || (k % 2) AS src_computer, 'C' || k AS dst_computer,
               event_type AS auth_type, 'Type' || k AS logon_type,
               CASE WHEN value < 50 THEN 'LogOn' ELSE 'LogOff' END AS auth_orientation,
               CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END AS success,
               event_type <> 'error' AS is_success, value
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    "keyed": """
        SELECT *, CAST(time // 86400 + 1 AS INTEGER) AS day,
               sha256(src_user)[1:8] AS user_id, sha256(src_computer)[1:8] AS host_id,
               '<*> <*> <*> <*> auth_type=' || auth_type || ' <*> auth_orientation='
                 || auth_orientation || ' success=' || success AS signature,
               '<*> <*> <*> <*> auth_type=' || auth_type || ' logon_type=' || logon_type
                 || ' auth_orientation=' || auth_orientation || ' success=' || success AS long_signature
        FROM auth""",
    "sigs": """
        SELECT signature, min(time) AS first_seen, count(*) AS n_events FROM keyed GROUP BY signature""",
    "templates": """
        SELECT *, CAST(row_number() OVER (ORDER BY first_seen, signature) AS INTEGER) AS template_id
        FROM sigs""",
    "ev": """
        SELECT k.*, t.template_id,
               t.template_id || '_' || auth_type || '_' || logon_type AS token
        FROM keyed k JOIN templates t USING (signature)""",
    "placed": """
        SELECT *, time - t0 AS d
        FROM (SELECT *, min(time) OVER (PARTITION BY day, user_id, host_id) AS t0 FROM ev)""",
    "win": """
        SELECT *, t0 + k * 43200 AS start_ts
        FROM (SELECT *, unnest(range(CAST(greatest(0, floor((d - 86400) / 43200.0) + 1) AS BIGINT),
                                     CAST(floor(d / 43200.0) AS BIGINT) + 1)) AS k FROM placed)""",
    "ranked": """
        SELECT *, sha256(day || '|' || user_id || '|' || host_id || '|' || start_ts) AS session_id,
               count(*) OVER w AS n,
               row_number() OVER (w ORDER BY time, line_no) - 1 AS pos,
               row_number() OVER (w ORDER BY time DESC, line_no DESC) AS newest
        FROM win WINDOW w AS (PARTITION BY day, user_id, host_id, start_ts)""",
    "rows_in": "SELECT * FROM ranked WHERE n >= 3",
    "sess": """
        SELECT session_id, day, user_id, host_id, start_ts, start_ts + 86400 AS end_ts,
               count(*) AS n_events
        FROM rows_in GROUP BY ALL""",
    "counts": 'SELECT token, count(*) AS "count" FROM rows_in GROUP BY token',
    "train_counts": 'SELECT token, count(*) AS "count" FROM rows_in WHERE day <= 20 GROUP BY token',
    "vocab": """
        SELECT token, CAST(row_number() OVER (ORDER BY "count" DESC, token) + 4 AS INTEGER) AS token_id
        FROM train_counts WHERE "count" >= 5
        UNION ALL SELECT * FROM (VALUES ('[CLS]', 0), ('[SEP]', 1), ('[MASK]', 2), ('[PAD]', 3), ('[UNK]', 4))""",
    "enc": """
        SELECT r.day, r.session_id, CAST(r.pos AS INTEGER) AS pos, r.newest, r.token,
               CAST(coalesce(v.token_id, 4) AS INTEGER) AS token_id
        FROM rows_in r LEFT JOIN vocab v USING (token)""",
    "seq": """
        SELECT day, session_id, count(*) AS n_events,
               count(*) FILTER (WHERE token_id = 4) AS n_unknown,
               [0] || list(token_id ORDER BY pos) FILTER (WHERE newest <= 10) || [1]
                 || list_resize(CAST([] AS INTEGER[]), greatest(10 - count(*), 0), 3) AS input_ids,
               least(count(*), 10) + 2 AS used
        FROM enc GROUP BY day, session_id""",
    "scored": """
        SELECT event_id, 'U' || user_id AS entity, epoch_us(ts) // 1000000 AS time,
               CASE event_type WHEN 'error' THEN 'T1486' WHEN 'purchase' THEN 'T1003'
                    WHEN 'signup' THEN 'T1053' WHEN 'click' THEN 'T1018' ELSE 'T0000' END AS technique_id,
               least(value / 50, 1.0::DOUBLE) * 0.6::DOUBLE
                 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 * 0.4::DOUBLE AS score
        FROM events""",
    "risk": """
        SELECT entity, sum(0.05::DOUBLE * score * power(0.95::DOUBLE, later)) AS risk_score,
               CAST(count(*) FILTER (WHERE score >= 0.75) AS INTEGER) AS anomaly_count,
               max(time) AS last_seen
        FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time DESC, event_id DESC) - 1 AS later
              FROM scored)
        GROUP BY entity""",
    "messages": r"""
        SELECT conv_id, turn, CAST(variant AS INTEGER) AS variant,
               CASE variant WHEN 0 THEN text WHEN 1 THEN ' ' || chr(9) || ' ' WHEN 2 THEN NULL
                    WHEN 3 THEN 'GET /health' WHEN 4 THEN 'GET /healthz'
                    WHEN 5 THEN 'POST /metrics' || chr(10) || text
                    ELSE text || chr(10) || chr(10) || text END AS original
        FROM conversations, range(7) AS v(variant)""",
    "long_sigs": """
        SELECT long_signature AS signature, min(time) AS first_seen, count(*) AS n_events
        FROM keyed GROUP BY long_signature""",
    "known": """
        SELECT *, CAST(row_number() OVER (ORDER BY first_seen, signature) AS INTEGER) AS template_id
        FROM (SELECT long_signature AS signature, min(time) AS first_seen, count(*) AS n_events
              FROM keyed WHERE time < 86400 GROUP BY long_signature)""",
    "drained": """
        SELECT '<*> dst_user=UNKNOWN <*> <*> auth_type=' || auth_type || ' logon_type=' || logon_type
                 || ' auth_orientation=UNKNOWN success=' || success AS signature,
               min(time) AS first_seen, count(*) AS n_events
        FROM auth GROUP BY 1""",
    "alike": """
        SELECT a.signature AS a, b.signature AS b
        FROM (SELECT *, string_split(signature, ' ') AS t FROM drained) a,
             (SELECT *, string_split(signature, ' ') AS t FROM drained) b
        WHERE len(list_filter(list_zip(a.t, b.t), lambda p: p[1] = p[2] AND p[1] <> '<*>')) >= 3.2""",
    "linked": """
        SELECT signature AS member, signature AS other FROM drained
        UNION SELECT member, b FROM linked JOIN alike ON other = a""",
    "groups": """
        SELECT member, arg_min(other, (first_seen, other)) AS leader
        FROM linked JOIN drained ON other = signature GROUP BY member""",
    "texts": """
        SELECT leader, string_agg(token, ' ' ORDER BY place) AS template
        FROM (SELECT leader, place,
                     CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS token
              FROM (SELECT leader, unnest(range(1, 9)) AS place, unnest(string_split(member, ' ')) AS token
                    FROM groups)
              GROUP BY leader, place)
        GROUP BY leader""",
    "first_linked": """
        SELECT signature AS member, signature AS other FROM drained WHERE first_seen < 86400
        UNION SELECT member, b FROM first_linked JOIN alike ON other = a
              JOIN drained ON b = signature WHERE first_seen < 86400""",
    "first_ids": """
        SELECT member AS signature, dense_rank() OVER (ORDER BY first_seen, leader) AS stored_id
        FROM (SELECT member, arg_min(other, (first_seen, other)) AS leader
              FROM first_linked JOIN drained ON other = signature GROUP BY member)
        JOIN drained ON leader = signature""",
    "met": """
        SELECT leader, min(stored_id) AS oldest FROM groups LEFT JOIN first_ids ON member = signature
        GROUP BY leader""",
    "met_ids": """
        SELECT leader, coalesce(oldest, (SELECT max(stored_id) FROM first_ids)
                 + row_number() OVER (PARTITION BY oldest IS NULL ORDER BY first_seen, leader)) AS template_id
        FROM met JOIN drained ON leader = signature""",
    "wide": """
        SELECT signature, min(time) AS first_seen, count(*) AS n_events, string_split(signature, ' ') AS t
        FROM (SELECT time, translate(src_user, '0123456789', 'abcdefghij') || ' ' || auth_type || '-'
                || translate(src_computer, '01', 'ab') || ' ' || auth_orientation AS signature FROM auth)
        GROUP BY signature""",
    "wide_names": """
        SELECT t[1] AS name, row_number() OVER (ORDER BY min(first_seen), t[1]) AS r FROM wide GROUP BY t[1]""",
    "wide_leaves": """
        SELECT wide.*, CASE WHEN r < 100 THEN name ELSE '*' END AS leaf FROM wide JOIN wide_names ON name = t[1]""",
    "wide_alike": """
        SELECT a.signature AS a, b.signature AS b FROM wide_leaves a JOIN wide_leaves b USING (leaf)
        WHERE len(list_filter(list_zip(a.t, b.t), lambda p: p[1] = p[2])) >= 1.8""",
    "wide_linked": """
        SELECT signature AS member, signature AS other FROM wide
        UNION SELECT member, b FROM wide_linked JOIN wide_alike ON other = a""",
    "wide_groups": """
        SELECT member, arg_min(other, (first_seen, other)) AS leader
        FROM wide_linked JOIN wide ON other = signature GROUP BY member""",
    "wide_texts": """
        SELECT leader, string_agg(token, ' ' ORDER BY place) AS template
        FROM (SELECT leader, place,
                     CASE WHEN count(DISTINCT token) = 1 THEN min(token) ELSE '<*>' END AS token
              FROM (SELECT leader, unnest(range(1, 4)) AS place, unnest(string_split(member, ' ')) AS token
                    FROM wide_groups)
              GROUP BY leader, place)
        GROUP BY leader""",
    "lines": r"""
        SELECT *, CASE WHEN value < 3 THEN 0 WHEN value < 20 THEN 7 ELSE 9 END AS fields FROM keyed""",
}

TEMPLATE_COLUMNS = "signature AS template, 8 AS n_tokens, first_seen, n_events"


def _sql(query: str) -> str:
    """``query`` with the named subqueries before it."""
    parts = ", ".join(f"{name} AS ({text})" for name, text in PARTS.items())
    return f"WITH RECURSIVE {parts} {query}"


ORACLE = {
    "parse_auth_lines": """
        SELECT line_no, time, src_user, src_computer, dst_computer, auth_type, logon_type, success,
               CASE fields WHEN 9 THEN dst_user ELSE 'UNKNOWN' END AS dst_user,
               CASE fields WHEN 9 THEN auth_orientation ELSE 'UNKNOWN' END AS auth_orientation,
               src_user AS "user", src_computer AS host, is_success, day
        FROM lines WHERE fields > 0""",
    "parse_counters": """
        SELECT count(*) AS total_lines, count(*) FILTER (WHERE fields > 0) AS parsed_lines,
               count(*) FILTER (WHERE fields = 0) AS skipped_lines,
               count(*) FILTER (WHERE fields > 0 AND day BETWEEN 3 AND 20) AS bucketed_events,
               count(DISTINCT day) FILTER (WHERE fields > 0 AND day BETWEEN 3 AND 20) AS processed_days
        FROM lines""",
    "events_per_day": """
        SELECT day, count(*) AS events FROM lines
        WHERE fields > 0 AND day BETWEEN 3 AND 20 GROUP BY day""",
    "pseudonymised_events": """
        SELECT line_no, time, day, user_id, host_id, auth_type, logon_type, auth_orientation, success,
               'UNK' AS event_id
        FROM keyed""",
    "identity_fallback": """
        SELECT event_id,
               CASE WHEN event_type = 'purchase' THEN sha256('UNKNOWN')[1:8]
                    WHEN event_type = 'signup' THEN 'UNKNOWN'
                    ELSE sha256('U' || user_id)[1:8] END AS user_id,
               CASE WHEN event_type = 'view' AND user_id <> 0 THEN sha256(CAST(user_id AS VARCHAR))[1:8]
                    ELSE sha256('UNKNOWN')[1:8] END AS host_id
        FROM events""",
    "session_windows": "SELECT day, user_id, host_id, start_ts, end_ts, n_events FROM sess",
    "sessions_job": """
        SELECT session_id, day, start_ts,
               string_agg(CAST(template_id AS VARCHAR), ',' ORDER BY pos) AS event_ids
        FROM rows_in GROUP BY ALL""",
    "session_events_last_n": """
        SELECT session_id, day, user_id, host_id, start_ts, start_ts + 86400 AS end_ts,
               string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY pos) AS event_ids,
               string_agg(CAST(time AS VARCHAR), ',' ORDER BY pos) AS times
        FROM rows_in WHERE newest <= 4 GROUP BY ALL""",
    "session_windows_gaps": """
        SELECT day, user_id, host_id, start_ts, start_ts + 7200 AS end_ts, count(*) AS n_events
        FROM (SELECT *, t0 + (d // 10800) * 10800 AS start_ts FROM placed WHERE d % 10800 < 7200)
        GROUP BY day, user_id, host_id, start_ts""",
    "split_sessions": """
        SELECT split, count(day) AS sessions, count(DISTINCT day) AS days
        FROM (VALUES ('train', 1, 20), ('val', 21, 25), ('test', 26, 30), ('all', 1, 30)) AS s(split, a, b)
        LEFT JOIN sess ON day BETWEEN a AND b GROUP BY split""",
    "stored_lines_per_day": "SELECT day, count(*) AS events FROM lines WHERE fields > 0 GROUP BY day",
    "session_day_rerun": """
        SELECT day, session_id, n_events FROM sess WHERE day NOT BETWEEN 5 AND 9 OR n_events >= 9""",
    "template_drain": """
        SELECT signature, CAST(dense_rank() OVER (ORDER BY led.first_seen, leader) AS INTEGER) AS template_id,
               template, 8 AS n_tokens, drained.first_seen, n_events
        FROM drained JOIN groups ON signature = member
        JOIN (SELECT leader, first_seen FROM groups JOIN drained ON leader = signature GROUP BY ALL) led USING (leader)
        JOIN texts USING (leader)""",
    "template_merged_runs": """
        SELECT d.signature, CAST(coalesce(stored_id, template_id) AS INTEGER) AS stored_id,
               CAST(template_id AS INTEGER) AS template_id, template
        FROM drained d JOIN groups ON d.signature = member JOIN met_ids USING (leader) JOIN texts USING (leader)
        LEFT JOIN first_ids USING (signature)""",
    "template_wide_tree": """
        SELECT wide.signature, CAST(dense_rank() OVER (ORDER BY led.first_seen, leader) AS INTEGER) AS template_id,
               template, 3 AS n_tokens, wide.first_seen, wide.n_events
        FROM wide JOIN wide_groups ON wide.signature = member JOIN wide led ON leader = led.signature
        JOIN wide_texts USING (leader)""",
    "coerced_events": """
        SELECT event_id AS "row",
               CASE event_type WHEN 'view' THEN CAST('10' || event_id AS BIGINT) ELSE event_id END AS time,
               CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR)
                    WHEN value < 50 THEN CAST(user_id AS VARCHAR) ELSE 'UNK' END AS event_id,
               sha256('U' || user_id)[1:8] AS user_id
        FROM events WHERE event_type IN ('click', 'view', 'signup')""",
    "session_summary": """
        SELECT count(*) AS sessions, count(*) AS non_empty_sessions,
               CAST(sum(n_events) AS BIGINT) AS total_events FROM sess""",
    "sessions_per_day": "SELECT day, count(*) AS sessions FROM sess GROUP BY day",
    "token_quality": """
        SELECT count(*) AS total_events, CAST(0 AS BIGINT) AS missing_event_ids,
               count(DISTINCT token) AS distinct_tokens FROM rows_in""",
    "coerced_sessions": """
        SELECT event_id,
               CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k || ',' || k ELSE '' END AS ks,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS invalid_event_containers,
               CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS dropped_events
        FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)""",
    "malformed_counters": """
        SELECT count(*) FILTER (WHERE event_type = 'error') AS invalid_event_containers,
               3 * count(*) FILTER (WHERE event_type = 'click') AS dropped_events FROM events""",
    "masked_documents": r"""
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
                 '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g'),
                 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'),
                 '\b[a-fA-F0-9]{32,64}\b', '<HASH>', 'g'),
                 '\b(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}\b', '<TIMESTAMP>', 'g'),
                 '\buser=\w+\b', '<USER>', 'g') AS masked
        FROM documents""",
    "template_messages": """
        SELECT line_no, 'src_user=' || src_user || ' dst_user=UNKNOWN src_computer=' || src_computer
               || ' dst_computer=' || dst_computer || ' auth_type='
               || CASE auth_type WHEN 'view' THEN 'UNKNOWN' ELSE auth_type END
               || ' logon_type=' || logon_type || ' auth_orientation=' || auth_orientation
               || ' success=' || success AS message
        FROM auth""",
    "template_signatures": """
        SELECT regexp_replace(message, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS signature,
               min(time) AS first_seen, count(*) AS n_events
        FROM (SELECT time, 'src_user=' || src_user || ' dst_user=' || dst_user || ' src_computer='
                || src_computer || ' dst_computer=' || dst_computer || ' auth_type=' || auth_type
                || ' logon_type=' || logon_type || ' auth_orientation=' || auth_orientation
                || ' success=' || success AS message FROM auth)
        GROUP BY 1""",
    "template_ids": f"""
        SELECT signature, {TEMPLATE_COLUMNS},
               CAST(row_number() OVER (ORDER BY first_seen, signature) AS INTEGER) AS template_id
        FROM long_sigs""",
    "template_reuse": f"""
        SELECT signature, signature AS template, 8 AS n_tokens, known.first_seen, long_sigs.n_events,
               template_id
        FROM known JOIN long_sigs USING (signature)
        UNION ALL
        SELECT signature, {TEMPLATE_COLUMNS},
               CAST((SELECT count(*) FROM known) + row_number() OVER (ORDER BY first_seen, signature)
                    AS INTEGER) AS template_id
        FROM long_sigs WHERE signature NOT IN (SELECT signature FROM known)""",
    "template_enriched": """
        SELECT line_no, coalesce(template_id, -1) AS template_id,
               coalesce(CAST(template_id AS VARCHAR), 'UNK') AS event_id
        FROM keyed LEFT JOIN known ON long_signature = known.signature""",
    "template_params": """
        SELECT line_no, 'src_user=' || src_user || ',dst_user=' || dst_user || ',src_computer='
               || src_computer || ',dst_computer=' || dst_computer || ',logon_type=' || logon_type AS params
        FROM auth""",
    "template_count": "SELECT count(*) AS templates FROM long_sigs",
    "token_counts": 'SELECT token, "count" FROM counts',
    "vocabulary": "SELECT token, token_id FROM vocab",
    "top_tokens": """
        SELECT token, CAST(row_number() OVER (ORDER BY "count" DESC, token) + 4 AS INTEGER) AS token_id
        FROM counts WHERE "count" >= 5 QUALIFY token_id < 50
        UNION ALL SELECT token, token_id FROM vocab WHERE token_id < 5""",
    "vocabulary_check": """
        SELECT count(*) AS size, max(token_id) AS max_token_id, CAST(0 AS BIGINT) AS missing_specials,
               count(*) - count(DISTINCT token_id) AS repeated_ids,
               count(*) - count(DISTINCT token) AS repeated_tokens FROM vocab""",
    "distinct_tokens": "SELECT DISTINCT token FROM rows_in",
    "encoded_events": "SELECT day, session_id, pos, token, token_id FROM enc",
    "unknown_rate": """
        SELECT count(*) FILTER (WHERE token_id = 4) AS unknown_events, count(*) AS total_events FROM enc""",
    "split_reuse": """
        SELECT day, count(DISTINCT session_id) AS sessions, count(*) AS n_events,
               count(*) FILTER (WHERE token_id = 4) AS n_unknown
        FROM enc WHERE day BETWEEN 21 AND 25 GROUP BY day""",
    "token_sequences": """
        SELECT day, session_id, array_to_string(input_ids, ',') AS input_ids, n_events, n_unknown FROM seq""",
    "attention_masks": """
        SELECT session_id,
               rtrim(repeat('1,', CAST(used AS BIGINT)) || repeat('0,', CAST(12 - used AS BIGINT)), ',')
                 AS attention_mask
        FROM seq""",
    "decoded_sequences": """
        SELECT s.session_id, string_agg(v.token, ' ' ORDER BY s.pos) AS tokens
        FROM (SELECT session_id, unnest(input_ids) AS token_id,
                     generate_subscripts(input_ids, 1) AS pos FROM seq) s
        JOIN vocab v USING (token_id) GROUP BY s.session_id""",
    "chunk_assignment": """
        SELECT session_id,
               (row_number() OVER (ORDER BY day, user_id, host_id, start_ts) - 1) // 100 AS chunk
        FROM sess""",
    "sequence_chunks": """
        SELECT 'all' AS split, chunk, count(DISTINCT session_id) AS sessions, CAST(0 AS BIGINT) AS invalid_rows,
               count(*) FILTER (WHERE token_id = 4) AS unknown_events, count(*) AS total_events
        FROM enc JOIN (SELECT session_id, (row_number() OVER (ORDER BY day, session_id) - 1) // 100 AS chunk
                       FROM sess) USING (session_id)
        GROUP BY chunk""",
    "resumable_chunks": """
        SELECT a.chunk FROM (SELECT *, (row_number() OVER (ORDER BY day, session_id) - 1) // 5 AS chunk FROM sess) a
        FULL JOIN (SELECT session_id, (row_number() OVER (ORDER BY day, session_id) - 1) // 5 AS chunk
                   FROM sess WHERE day <> 7) b ON a.session_id = b.session_id AND a.chunk = b.chunk
        GROUP BY a.chunk HAVING a.chunk IS NOT NULL AND bool_and(b.chunk IS NOT NULL) AND bool_and(day <> 20)""",
    "sequence_manifest": """
        SELECT CAST(ceil(count(DISTINCT session_id) / 100) AS BIGINT) AS chunk_count,
               count(DISTINCT session_id) AS session_count, 12 AS max_len,
               count(*) FILTER (WHERE token_id = 4) AS unknown_events, count(*) AS total_events,
               CAST(0 AS BIGINT) AS invalid_rows
        FROM enc""",
    "single_sequences": "SELECT day, count(*) AS sequences FROM sess GROUP BY day",
    "sequence_completeness": "SELECT * FROM (VALUES (0, true), (1, false)) AS t(more, complete)",
    "session_shards": """
        SELECT day, count(*) AS sessions, max(session_id) AS last_id FROM sess WHERE day IN (4, 11, 30)
        GROUP BY day""",
    "stored_vocabulary": "SELECT token, token_id, token_id AS json_id FROM vocab",
    "vocabulary_check_damaged": """
        SELECT count(*) AS size, max(token_id) AS max_token_id, CAST(1 AS BIGINT) AS missing_specials,
               count(*) - count(DISTINCT token_id) AS repeated_ids,
               count(*) - count(DISTINCT token) AS repeated_tokens
        FROM (SELECT token, token_id FROM vocab WHERE token <> '[MASK]'
              UNION ALL SELECT token || '+', token_id FROM vocab WHERE token_id BETWEEN 5 AND 7
              UNION ALL SELECT token, token_id + 100000 FROM vocab WHERE token_id = 6)""",
    "token_quality_placeholders": """
        SELECT count(*) AS total_events, count(*) FILTER (WHERE event_type <> 'purchase') AS missing_event_ids,
               count(DISTINCT CASE event_type WHEN 'purchase' THEN CAST(user_id AS VARCHAR) ELSE event_type END)
                 AS distinct_tokens FROM events""",
    "training_splits": """
        SELECT split, count(day) AS sessions
        FROM (VALUES ('pretrain', 1, 50), ('finetune', 51, 55), ('test', 56, 58)) AS s(split, a, b)
        LEFT JOIN sess ON day BETWEEN a AND b GROUP BY split""",
    "masked_examples": """
        SELECT session_id,
               array_to_string(list_transform(drawn, lambda d: CASE
                 WHEN NOT d.chosen THEN d.t WHEN d.kind < 0.8 THEN 2
                 WHEN d.kind < 0.9 THEN d.other % greatest(size - 5, 1) + 5 ELSE d.t END), ',') AS masked_ids,
               array_to_string(list_transform(drawn, lambda d: CASE WHEN d.chosen THEN d.t ELSE -100 END), ',') AS labels
        FROM (SELECT session_id, size, list_transform(input_ids, lambda t, i: {
                't': t, 'chosen': t > 4 AND ('0x' || md5(session_id || '|' || (i - 1) || '|0|0')[1:8])::BIGINT
                                            % 1000000 / 1000000.0::DOUBLE < 0.15::DOUBLE,
                'kind': ('0x' || md5(session_id || '|' || (i - 1) || '|0|1')[1:8])::BIGINT % 1000000 / 1000000.0::DOUBLE,
                'other': ('0x' || md5(session_id || '|' || (i - 1) || '|0|2')[1:8])::BIGINT}) AS drawn
              FROM seq, (SELECT count(*) AS size FROM vocab))""",
    "sound_days": "SELECT DISTINCT day FROM sess WHERE day <> 7",
    "missing_days": """
        SELECT CAST(day AS INTEGER) AS day FROM range(26, 36) AS r(day)
        WHERE day NOT IN (SELECT day FROM sess)""",
    "resume_antijoin": "SELECT day, session_id FROM sess WHERE day > 20",
    "ingest_clean": r"""
        SELECT conv_id, turn, variant, original, 'raw_logs' AS dataset FROM messages
        WHERE original IS NOT NULL AND NOT regexp_matches(original, '(?m)^\s*$')
          AND NOT regexp_matches(original, '(?m)^(GET /health|GET /ready|POST /metrics)$')""",
    "ingest_refused": """
        SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, count(*) AS n,
               CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS "offset"
        FROM events WHERE event_type = 'click' GROUP BY 1
        UNION ALL
        SELECT NULL, NULL, CASE event_type WHEN 'error' THEN props[1:4] WHEN 'signup' THEN '[' || props || ']'
                 WHEN 'view' THEN '{"k": "k' || event_id || '"}' END, event_id
        FROM events WHERE event_type <> 'click'""",
    "severity_bands": """
        SELECT event_id, round(score, 6) AS score, score >= 0.75 AS is_anomaly,
               CASE WHEN score >= 0.90 THEN 'critical' WHEN score >= 0.75 THEN 'high'
                    WHEN score >= 0.50 THEN 'medium' ELSE 'low' END AS severity
        FROM scored""",
    "risk_ewma": """
        SELECT entity AS entity_id, 'user' AS entity_type, round(risk_score, 6) AS risk_score,
               anomaly_count, last_seen FROM risk""",
    "percentiles_by_day": """
        SELECT (SELECT count(*) FROM scored) AS scores, level, round(bound, 6) AS bound
        FROM (SELECT unnest(['P1', 'P2', 'P3']) AS level, unnest([0.999, 0.99, 0.97]) AS p)
        JOIN (SELECT unnest([0.999, 0.99, 0.97]) AS p,
                     unnest(quantile_cont(score, [0.999, 0.99, 0.97])) AS bound FROM scored) USING (p)""",
    "token_quality_by_day": """
        SELECT split, count(day) AS total_events, CAST(0 AS BIGINT) AS missing_event_ids, true AS near
        FROM (VALUES ('train', 1, 20), ('val', 21, 25), ('test', 26, 30), ('all', 1, 30)) AS s(split, a, b)
        LEFT JOIN rows_in ON day BETWEEN a AND b GROUP BY split""",
    "id_collisions": """
        SELECT 'user_id' AS kind, sha256(src_user)[1:1] AS id, count(DISTINCT src_user) AS names
        FROM auth GROUP BY 2 HAVING names > 1
        UNION ALL SELECT 'host_id', sha256(src_computer)[1:1] AS id, count(DISTINCT src_computer) AS names
        FROM auth GROUP BY 2 HAVING names > 1""",
    "alert_severity": """
        SELECT event_id, round(score * 0.5::DOUBLE + risk_score * 0.3::DOUBLE
                 + CASE technique_id WHEN 'T1486' THEN 0.4 WHEN 'T1003' THEN 0.3 WHEN 'T1053' THEN 0.2
                        WHEN 'T1018' THEN 0.1 ELSE 0 END::DOUBLE * 0.2::DOUBLE, 6) AS alert_severity
        FROM scored JOIN risk USING (entity)""",
    "alert_percentiles": """
        SELECT event_id, CASE WHEN score >= p1 THEN 'P1' WHEN score >= p2 THEN 'P2'
                              WHEN score >= p3 THEN 'P3' ELSE 'none' END AS level
        FROM scored, (SELECT quantile_cont(score, 0.999) AS p1, quantile_cont(score, 0.99) AS p2,
                             quantile_cont(score, 0.97) AS p3 FROM scored)""",
}
ORACLE["token_counts_null_events"] = ORACLE["token_counts"]
ORACLE["risk_over_runs"] = ORACLE["risk_ewma"]
ORACLE["ingest_json"] = ORACLE["ingest_clean"]
ORACLE["session_events_hot"] = ORACLE["session_events_last_n"]
ORACLE["encoded_events_salted"] = ORACLE["encoded_events"]


def oracle_sql() -> dict[str, str]:
    return {name: _sql(query) for name, query in ORACLE.items()}
