"""DuckDB SQL twins of the trace queries, written on their own and not derived from the Spark plans."""

from __future__ import annotations

from strandline import schema
from strandline.plans.adapter import TRACE_SQL

_WITH = f"WITH {TRACE_SQL}"

#: Bracket matching over events with d = 1, -1 or 0 in groups g.
_MATCH = """
s AS (SELECT *, sum(d) OVER (PARTITION BY g ORDER BY geid) AS s FROM src),
lv AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY g ORDER BY geid)) AS depth FROM s),
pv AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY g ORDER BY geid), 0) AS prev FROM lv),
asked AS (SELECT *, CASE WHEN d <> 0 THEN prev ELSE depth END AS level FROM pv),
matched AS (
  SELECT a.* EXCLUDE (s, prev),
         (SELECT max(o.geid) FROM pv o WHERE o.g = a.g AND o.d = 1 AND o.depth = a.level AND o.geid < a.geid AND a.level > 0) AS enclosing
  FROM asked a
)"""
CALLS = f"{_WITH}, src AS (SELECT *, thread_id AS g, CASE kind WHEN 'Call' THEN 1 WHEN 'Return' THEN -1 ELSE 0 END AS d FROM trace), {_MATCH}"
TREE = f"""{CALLS}, tree AS (
  SELECT c.geid AS call_geid, c.thread_id, c.function_id, c.enclosing AS parent_geid, (c.depth - 1)::BIGINT AS depth,
         min(CASE WHEN i.kind = 'Return' THEN i.geid END) AS exit_geid, count(CASE WHEN i.kind = 'Call' THEN 1 END) AS children_count,
         count(CASE WHEN i.kind = 'Step' THEN 1 END) AS own_steps
  FROM matched c LEFT JOIN matched i ON i.enclosing = c.geid WHERE c.kind = 'Call' GROUP BY ALL
)"""
_STEPPED = f"{_WITH}, st AS (SELECT *, max(CASE WHEN kind = 'Step' THEN geid END) OVER (PARTITION BY thread_id ORDER BY geid) AS step_geid FROM trace)"
_IDS = f"{_WITH}, ids AS (SELECT geid, path_id, line, row_number() OVER (ORDER BY geid) - 1 AS step_id FROM trace WHERE kind = 'Step')"
_VALUE_AT = f"""{_STEPPED}, va AS (SELECT step_geid, row_number() OVER (PARTITION BY step_geid ORDER BY geid) - 1 AS i, function_id AS variable_id, value
  FROM st WHERE kind = 'Value' AND step_geid IS NOT NULL)"""
_CHUNKS = f"""{_WITH}, ch AS (SELECT (row_number() OVER (ORDER BY geid) - 1) // {schema.EVENTS_A_CHUNK} AS chunk_id, geid, strlen(content) + 17 AS size FROM trace),
chunks AS (SELECT chunk_id, min(geid) AS first_geid, count(*) AS event_count, sum(size)::BIGINT AS bytes FROM ch GROUP BY chunk_id)"""
_COVER = f"{_WITH}, cov AS (SELECT path_id, line, count(*) AS hits FROM trace WHERE kind = 'Step' GROUP BY ALL)"
_LABELS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(schema.TYPE_KINDS))
_SCOPES = f"""{_WITH}, sc AS (SELECT DISTINCT path_id, function_id FROM trace), cl AS (
  SELECT *, CASE WHEN path_id = 2 THEN 'skip' ELSE 'trace' END AS exec,
         CASE WHEN function_id IN (7, 8) THEN 'drop' ELSE 'allow' END AS value_default,
         CASE WHEN function_id IN (7, 8) THEN 2 WHEN path_id = 2 THEN 1 ELSE 0 END AS matched_rule
  FROM sc)"""
#: Patterns belong to rule 0 alone: a later rule that matches replaces them by none.
_ACTION = "CASE WHEN matched_rule <> 0 THEN value_default WHEN regexp_full_match(value_name, 'v[1-4]') THEN 'redact' WHEN value_name LIKE 'v%' THEN 'drop' ELSE value_default END"
ORACLES = {
    "step_enclosing_call": f"{CALLS} SELECT row_number() OVER (ORDER BY geid) - 1 AS step_id, geid, thread_id, path_id, line, enclosing AS call_geid, depth::BIGINT AS depth FROM matched WHERE kind = 'Step'",
    "call_tree": f"{TREE} SELECT * FROM tree",
    "call_children": f"{CALLS} SELECT enclosing AS call_geid, row_number() OVER (PARTITION BY enclosing ORDER BY geid) - 1 AS child_index, geid AS child_geid FROM matched WHERE kind = 'Call' AND enclosing IS NOT NULL",
    "return_matching": f"{CALLS} SELECT geid AS return_geid, enclosing AS call_geid FROM matched WHERE kind = 'Return'",
    "drop_last_step": f"""{_WITH}, src AS (SELECT *, 0 AS g, CASE kind WHEN 'Step' THEN 1 ELSE -1 END AS d FROM trace WHERE kind IN ('Step', 'Event')), {_MATCH}
        SELECT geid, path_id, line FROM trace WHERE kind = 'Step' AND geid NOT IN (SELECT enclosing FROM matched WHERE d = -1 AND enclosing IS NOT NULL)""",
    "step_ids": f"{_IDS} SELECT * FROM ids",
    "step_locations_range": f"{_IDS} SELECT step_id, path_id, line FROM ids WHERE step_id BETWEEN 100 AND 149",
    "seek_events": f"{_WITH} SELECT geid, kind, thread_id FROM trace WHERE geid >= 4090 AND geid < 4190",
    "kind_counts": f"{_WITH} SELECT kind, count(*) AS n FROM trace GROUP BY kind",
    "cardinalities": f"""{_WITH} SELECT count(*) FILTER (kind = 'Step') AS steps, count(*) FILTER (kind = 'Call') AS calls, count(*) FILTER (kind = 'Event') AS events,
        count(DISTINCT path_id) AS paths, count(DISTINCT function_id) AS functions FROM trace""",
    "dictionary_paths": f"""{_WITH}, f AS (SELECT 'src/file_' || path_id AS path, min(geid) AS first_geid FROM trace WHERE path_id IS NOT NULL GROUP BY 1)
        SELECT path, first_geid, row_number() OVER (ORDER BY first_geid) - 1 AS id FROM f""",
    "resolve_names": f"""{_WITH}, l(id, name) AS (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(schema.TYPE_KINDS[:8]))})
        SELECT coalesce(name, 'var_' || function_id) AS name, count(*) AS n FROM trace LEFT JOIN l ON id = function_id WHERE kind = 'Call' GROUP BY 1""",
    "type_kind_labels": f"""{_WITH}, l(id, label) AS (VALUES {_LABELS}) SELECT line % 40 AS kind_id, label, count(*) AS n FROM trace LEFT JOIN l ON id = line % 40 GROUP BY 1, 2""",
    "step_json": f"{_IDS} SELECT step_id, '{{\"kind\":\"step\",\"path_id\":' || path_id || ',\"line\":' || line || '}}' AS json FROM ids",
    "values_per_step": f"{_STEPPED} SELECT step_geid, count(*) FILTER (kind = 'Value') AS n_values FROM st WHERE step_geid IS NOT NULL GROUP BY 1",
    "value_at": f"{_VALUE_AT} SELECT * FROM va",
    "values_json": f"{_VALUE_AT} SELECT step_geid, string_agg(variable_id::VARCHAR, ',' ORDER BY i) AS variables FROM va GROUP BY 1",
    "value_history": f"""{_WITH} SELECT thread_id, function_id AS variable_id, geid AS from_geid, lead(geid) OVER w AS to_geid, row_number() OVER w - 1 AS version
        FROM trace WHERE kind = 'Value' WINDOW w AS (PARTITION BY thread_id, function_id ORDER BY geid)""",
    "asof_binding": f"{_WITH} SELECT e.geid, v.geid AS value_geid FROM (SELECT * FROM trace WHERE kind = 'Event') e ASOF LEFT JOIN (SELECT * FROM trace WHERE kind = 'Value') v ON e.thread_id = v.thread_id AND e.geid > v.geid",
    "thread_switches": f"{_WITH}, n AS (SELECT thread_id, lead(thread_id) OVER (ORDER BY geid) AS nx FROM trace) SELECT thread_id, count(*) AS switches FROM n WHERE nx <> thread_id GROUP BY 1",
    "current_thread": f"{_WITH} SELECT geid, coalesce(last_value(CASE WHEN kind = 'Event' THEN thread_id END IGNORE NULLS) OVER (ORDER BY geid), 0) AS thread_id FROM trace",
    "thread_lifetimes": f"{_WITH} SELECT thread_id, min(geid) AS start_geid, max(geid) AS exit_geid, count(*) AS n FROM trace GROUP BY 1",
    "dropped_variables": f"{_WITH}, x AS (SELECT geid, unnest([function_id, function_id + 10, path_id + 20]) AS variable_id FROM trace WHERE kind = 'Event') SELECT variable_id, max(geid) AS dropped_at, count(*) AS n FROM x GROUP BY 1",
    "assignment_lineage": f"""WITH RECURSIVE {TRACE_SQL}, e AS (SELECT DISTINCT path_id AS a, function_id AS b FROM trace WHERE kind = 'Value' AND path_id < function_id),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, count(*) AS reachable FROM r GROUP BY a""",
    "chunk_index": f"{_CHUNKS} SELECT * FROM chunks",
    "chunk_for_geid": f"""{_CHUNKS}, q AS (SELECT o_orderkey, o_orderkey * 7 % 12000 AS g FROM orders), a AS (SELECT q.*, chunk_id, first_geid, event_count FROM q ASOF JOIN chunks ON q.g >= first_geid)
        SELECT o_orderkey, g, chunk_id, first_geid FROM a WHERE g < first_geid + event_count""",
    "event_offsets": f"""{_WITH} SELECT geid, (strlen(content) + 17)::BIGINT AS size, coalesce(sum(strlen(content) + 17) OVER (ORDER BY geid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM trace""",
    "container_stats": """WITH d AS (SELECT source, strlen(coalesce(text, ''))::BIGINT AS size FROM documents), b AS (SELECT *, (size + 4095) // 4096 AS blocks FROM d)
        SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes, sum(blocks)::BIGINT AS data_blocks, sum((blocks + 510) // 511)::BIGINT AS mapping_blocks,
               greatest(0, sum(blocks) * 4096 - sum(size))::BIGINT AS waste FROM b GROUP BY source""",
    "size_format": """WITH s AS (SELECT doc_id, n_chars * 97 AS n FROM documents)
        SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown FROM s""",
    "file_sha256": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "hex_and_base64": "SELECT event_id, lower(hex(props)) AS hex, base64(props::BLOB) AS base64, base64(from_base64(base64(props::BLOB))) AS again FROM events",
    "uuid7_ms": """WITH t AS (SELECT event_id, event_id * 1000003 + 1700000000000 AS ms FROM events), h AS (SELECT *, lpad(lower(to_hex(ms)), 12, '0') AS x FROM t)
        SELECT event_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-7000-8000-000000000000' AS uuid, ms AS millis FROM h""",
    "http_errors": """WITH s AS (SELECT [200, 201, 400, 404, 408, 429, 500, 503][o_orderkey % 8 + 1] AS status FROM orders)
        SELECT CASE WHEN status < 400 THEN 'ok' WHEN status IN (408, 429) OR status >= 500 THEN 'retryable' ELSE 'fatal' END AS class, count(*) AS n FROM s GROUP BY 1""",
    "url_paths": """SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x NOT IN ('', '.')), '/')
               || CASE WHEN regexp_replace(url, '^[a-z]+://[^/]*', '') IN ('', '/') THEN 'b' ELSE '/b' END AS path FROM pages""",
    "correct_paths": "SELECT page_id, '<relative-to-this>/src/' || page_id || '.nr' AS path FROM pages",
    "module_names": "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'app.m' || p_partkey % 9 END AS module FROM part",
    "filter_exec": f"{_SCOPES} SELECT exec, matched_rule, count(*) AS n FROM trace JOIN cl USING (path_id, function_id) GROUP BY 1, 2",
    "filter_values": f"{_SCOPES}, nm AS (SELECT *, 'v' || (function_id * 7 % 10) AS value_name FROM cl) SELECT path_id, function_id, value_name, {_ACTION} AS action FROM nm",
    "redacted_values": f"""{_SCOPES}, nm AS (SELECT *, 'secret_key' AS value_name FROM cl), ac AS (SELECT path_id, function_id, exec, {_ACTION} AS action FROM nm)
        SELECT geid, CASE WHEN action = 'redact' THEN NULL ELSE line END AS shown FROM trace JOIN ac USING (path_id, function_id) WHERE kind = 'Value' AND exec = 'trace' AND action <> 'drop'""",
    "chained_filter": f"""{_WITH}, sc AS (SELECT DISTINCT path_id, function_id, 'app/m' || path_id || '.py' AS file, 'app.m' || path_id AS pkg, 'app.m' || path_id || '.f' || function_id AS obj,
          'v' || function_id % 5 AS value_name FROM trace),
        rule(i, kind, pattern, exec, value_default, source) AS (VALUES (0, 'pkg', 'app\\.[^/]*', NULL, 'redact', 0), (1, 'file', 'app/m[0-2]\\.py', NULL, 'drop', 1), (2, 'obj', 'app\\.m1\\.f[^/]*', 'skip', NULL, 1)),
        pat(rule, j, kind, pattern, action, source) AS (VALUES (0, 0, 'local', '^v3$', 'allow', 0), (0, 1, 'arg', '^v[^/]$', 'allow', 0), (1, 0, 'local', '[1-3]$', 'allow', 1)),
        hit AS (SELECT sc.*, rule.* FROM sc JOIN rule ON regexp_full_match(CASE kind WHEN 'pkg' THEN pkg WHEN 'file' THEN file ELSE obj END, pattern)),
        won AS (SELECT path_id, function_id, any_value(value_name) AS value_name, coalesce(arg_max(exec, i) FILTER (exec IS NOT NULL), 'trace') AS exec,
          coalesce(arg_max(value_default, i) FILTER (value_default IS NOT NULL), 'allow') AS value_default, coalesce(arg_max(source, i) FILTER (value_default IS NOT NULL), 0) AS since, max(i) AS matched_rule FROM hit GROUP BY 1, 2),
        asked AS (SELECT won.*, k.value_kind FROM won, (VALUES ('local'), ('arg')) k(value_kind)),
        first AS (SELECT path_id, function_id, value_kind, arg_min(action, j) AS action FROM asked JOIN pat ON pat.rule = matched_rule AND pat.kind = value_kind AND regexp_matches(value_name, pattern)
          WHERE NOT (value_default = 'drop' AND pat.source < since) GROUP BY ALL)
        SELECT path_id, function_id, value_kind, value_name, exec, value_default, matched_rule, coalesce(first.action, value_default) AS action FROM asked LEFT JOIN first USING (path_id, function_id, value_kind)""",
    "hinted_modules": f"""{_WITH}, sc AS (SELECT DISTINCT path_id, function_id FROM trace), m AS (SELECT *, CASE function_id % 3 WHEN 0 THEN 'pkg.f' || function_id ELSE 'app.m' || path_id END AS module FROM sc)
        SELECT path_id, function_id, module, module || CASE WHEN path_id <> 3 THEN '.run' || function_id ELSE '' END AS object FROM m""",
    "project_roots": """WITH f AS (SELECT p_partkey, '/w/p' || p_partkey % 40 || '/q' || p_partkey % 7 || '/f' || p_partkey || '.py' AS path FROM part),
        r AS (SELECT '/w/p' || s_suppkey % 60 || CASE WHEN s_suppkey % 2 = 0 THEN '/q' || s_suppkey % 9 || '/' ELSE '' END AS root, s_suppkey AS source FROM supplier),
        h AS (SELECT f.*, root, source, row_number() OVER (PARTITION BY p_partkey ORDER BY length(rtrim(root, '/')) DESC, source) AS k FROM f JOIN r ON starts_with(path, rtrim(root, '/') || '/'))
        SELECT f.p_partkey, root, source, substr(f.path, length(rtrim(root, '/')) + 2) AS relative FROM f LEFT JOIN h ON h.p_partkey = f.p_partkey AND k = 1""",
    "longest_project_root": """WITH f AS (SELECT p_partkey, '/w/p' || p_partkey % 4 || '/q' || p_partkey % 3 || '/f.py' AS path FROM part),
        r AS (SELECT f.*, root, row_number() OVER (PARTITION BY p_partkey ORDER BY length(root) DESC) AS k FROM f JOIN (VALUES ('/w'), ('/w/p1'), ('/w/p1/q2'), ('/w/p2')) t(root) ON starts_with(path, root || '/'))
        SELECT p_partkey, root, substr(path, length(root) + 2) AS relative FROM r WHERE k = 1""",
    "retry_pending": """WITH r AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC,
            CASE l_returnflag WHEN 'A' THEN 'uploaded' WHEN 'R' THEN 'retryable_failure' ELSE 'fatal_failure' END DESC) AS k, count(*) OVER (PARTITION BY l_partkey) AS attempts FROM lineitem)
        SELECT l_partkey, attempts FROM r WHERE k = 1 AND l_returnflag = 'R'""",
    "line_coverage": f"{_COVER} SELECT * FROM cov",
    "hot_lines_topk": f"{_COVER}, k AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY hits DESC, line) AS rank FROM cov) SELECT * FROM k WHERE rank <= 3",
    "function_profile": f"{TREE} SELECT function_id, count(*) AS calls, sum(own_steps)::BIGINT AS steps, max(depth) AS max_depth, count(exit_geid) AS returned FROM tree GROUP BY 1",
    "trace_diff": f"{_WITH} SELECT DISTINCT path_id, line FROM trace WHERE kind = 'Step' AND thread_id % 2 = 0 EXCEPT SELECT path_id, line FROM trace WHERE kind = 'Step' AND thread_id % 2 = 1",
    "shared_lines": f"{_WITH} SELECT path_id, line FROM trace WHERE kind = 'Step' AND thread_id % 2 = 0 INTERSECT SELECT path_id, line FROM trace WHERE kind = 'Step' AND thread_id % 2 = 1",
    "kind_path_cube": f"{_WITH} SELECT kind, path_id, count(*) AS n FROM trace GROUP BY CUBE (kind, path_id)",
    "path_function_rollup": f"{_WITH} SELECT path_id, function_id, count(*) AS n, min(geid) AS first_geid FROM trace GROUP BY ROLLUP (path_id, function_id)",
    "kind_pivot": f"{_WITH} SELECT path_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in ("Call", "Event", "Return", "Step", "Value")) + " FROM trace GROUP BY path_id",
    "value_steps": f"""{_WITH} SELECT geid, line - lag(line) OVER (PARTITION BY thread_id ORDER BY geid) AS change, (sum(line) OVER (PARTITION BY thread_id ORDER BY geid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS recent,
        dense_rank() OVER (PARTITION BY thread_id ORDER BY line) AS place FROM trace WHERE kind = 'Value'""",
    "windowed_event_rate": f"{_WITH} SELECT (floor(epoch(ts))::BIGINT // 3600) * 3600 AS start_s, kind, count(*) AS n FROM trace GROUP BY 1, 2",
    "thread_sessions": f"""{_WITH}, c AS (SELECT thread_id, geid, CASE WHEN geid - lag(geid) OVER (PARTITION BY thread_id ORDER BY geid) > 200 THEN 1 ELSE 0 END AS cut FROM trace),
        s AS (SELECT thread_id, geid, (sum(cut) OVER (PARTITION BY thread_id ORDER BY geid))::BIGINT AS session FROM c) SELECT thread_id, session, count(*) AS n, min(geid) AS from_geid FROM s GROUP BY 1, 2""",
    "log_fold": f"{_WITH} SELECT CASE line % 14 WHEN 0 THEN 0 WHEN 11 THEN 3 ELSE 2 END AS folded, count(*) AS n FROM trace WHERE kind = 'Event' GROUP BY 1",
    "conversation_stream": """SELECT conv_id, turn, lag(role) OVER w AS before, (sum(length(text)) OVER w)::BIGINT AS offset_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
}
