"""DuckDB SQL twins of the queries over values, calls and IO events."""

from __future__ import annotations

from strandline import schema
from strandline.plans.adapter import TRACE_SQL
from strandline.plans.oracles import CALLS, TREE

_WITH = f"WITH {TRACE_SQL}"
_NUMBER = {k: i for i, k in enumerate(schema.TYPE_KINDS)}
#: What is shown of a value with this geid and line, and its kind, straight from both numbers.
SHOWN = """CASE geid % 15 WHEN 0 THEN line::VARCHAR WHEN 1 THEN line || '.5' WHEN 2 THEN (line % 2 = 0)::VARCHAR WHEN 3 THEN 's"' || line WHEN 4 THEN '[...]' WHEN 5 THEN '(...)'
  WHEN 6 THEN '{...}' WHEN 7 THEN 'Case' || line % 3 WHEN 8 THEN '0x' || lower(to_hex(geid * 4096 + line)) WHEN 9 THEN 'raw ' || line WHEN 10 THEN 'no value' WHEN 11 THEN 'None'
  WHEN 12 THEN 'place_' || line WHEN 13 THEN CASE line % 2 WHEN 1 THEN '-' ELSE '' END || '(bigint)' ELSE chr((97 + line % 26)::INT) END"""
_TYPE = "CASE geid % 15 WHEN 12 THEN 'Cell' WHEN 6 THEN 'type_6' ELSE 'type_' || geid % 34 END"
_KINDS = ("Int", "Float", "Bool", "String", "Seq", "Tuple", "Struct", "Variant", "Pointer", "Raw", "Error", "None", "Raw", "Int", "Char")
_KIND = "[" + ", ".join(str(_NUMBER[k]) for k in _KINDS) + "][geid % 15 + 1]"
_NAMES = "['Int', 'Float', 'Bool', 'String', 'Sequence', 'Tuple', 'Struct', 'Variant', 'Reference', 'Raw', 'Error', 'None', 'Cell', 'BigInt', 'Char'][geid % 15 + 1]"
_VALUES = f"{_WITH}, v AS (SELECT geid, line, thread_id, function_id, {SHOWN} AS shown FROM trace WHERE kind = 'Value')"
_NODES = f"""{_VALUES}, c AS (
  SELECT geid, '' AS node, NULL AS parent, 0 AS pos, {_NAMES} AS kind, shown FROM v
  UNION ALL SELECT geid, i::VARCHAR, '', i::INT, 'Int', (line + i)::VARCHAR FROM v, range(2) t(i) WHERE geid % 15 = 4
  UNION ALL SELECT geid, '0', '', 0, 'Int', line::VARCHAR FROM v WHERE geid % 15 = 5
  UNION ALL SELECT geid, '1', '', 1, 'Bool', 'true' FROM v WHERE geid % 15 = 5
  UNION ALL SELECT geid, i::VARCHAR, '', i::INT, 'Int', (line + 5 + i)::VARCHAR FROM v, range(3) t(i) WHERE geid % 15 = 6
  UNION ALL SELECT geid, '0', '', 0, 'Sequence', '[...]' FROM v WHERE geid % 15 = 7
  UNION ALL SELECT geid, '0.0', '0', 0, 'Int', (line + 2)::VARCHAR FROM v WHERE geid % 15 = 7
  UNION ALL SELECT geid, '0', '', 0, 'Int', (line + 3)::VARCHAR FROM v WHERE geid % 15 = 8)"""
_QUOTED = "replace(shown, '\"', '\\\"')"
_STEPPED = f"""{_WITH}, st AS (SELECT *, {SHOWN} AS shown, max(CASE WHEN kind = 'Step' THEN geid END) OVER (PARTITION BY thread_id ORDER BY geid) AS step_geid FROM trace)"""
_KEYS = f"""{TREE}, sid AS (SELECT geid, row_number() OVER (ORDER BY geid) - 1 AS step_id FROM trace WHERE kind = 'Step'),
  near_ AS (SELECT t.geid, max(step_id) OVER (PARTITION BY thread_id ORDER BY t.geid) AS latest FROM trace t LEFT JOIN sid ON sid.geid = t.geid),
  keyed AS (SELECT *, row_number() OVER (ORDER BY call_geid) - 1 AS call_key FROM tree),
  called AS (SELECT k.call_key, k.call_geid, coalesce(p.call_key, -1)::BIGINT AS parent_key, k.function_id, k.depth, a.latest AS entry_step, z.latest AS exit_step, k.children_count
    FROM keyed k LEFT JOIN keyed p ON p.call_geid = k.parent_geid JOIN near_ a ON a.geid = k.call_geid LEFT JOIN near_ z ON z.geid = k.exit_geid)"""
_ARGS = f"""ends AS (SELECT geid, kind, thread_id FROM trace WHERE kind IN ('Call', 'Step', 'Return')),
  ar AS (SELECT v.geid, e.geid AS call_geid, v.function_id AS variable_id, v.shown FROM (SELECT *, {SHOWN} AS shown FROM trace WHERE kind = 'Value') v
    ASOF JOIN ends e ON v.thread_id = e.thread_id AND v.geid < e.geid WHERE e.kind = 'Call'),
  args AS (SELECT call_geid, row_number() OVER (PARTITION BY call_geid ORDER BY geid) - 1 AS i, variable_id, shown FROM ar)"""
_EXEC = f"""{_WITH}, sp AS (SELECT *, lag(thread_id) OVER (ORDER BY geid) AS running FROM trace WHERE kind = 'Step'),
  ex AS (SELECT geid, 1 AS part, thread_id, path_id, line FROM sp UNION ALL SELECT geid, 0, thread_id, path_id, line FROM sp WHERE running <> thread_id)"""
_IO = f"""{_WITH}, sid AS (SELECT geid, row_number() OVER (ORDER BY geid) - 1 AS step_id FROM trace WHERE kind = 'Step'),
  io AS (SELECT row_number() OVER (ORDER BY t.geid) - 1 AS i, CASE line % 14 WHEN 0 THEN 0 WHEN 11 THEN 3 ELSE 2 END AS kind, (line % 14)::INT AS log_kind, step_id, content AS data
    FROM (SELECT * FROM trace WHERE kind = 'Event') t ASOF LEFT JOIN sid ON t.geid >= sid.geid)"""

ORACLES = {
    "rendered_values": f"{_VALUES} SELECT geid, shown, {_KIND} AS type_kind, {_TYPE} AS type_name FROM v",
    "big_integers": f"""{_VALUES} SELECT geid, CASE line % 2 WHEN 1 THEN '-' ELSE '' END || (('0x' || lpad(to_hex(geid * 1000003 + line), 15, '0'))::HUGEINT
        + ('0x' || substr(lpad(to_hex(geid * 1000003 + line), 24, '01'), 1, 24 - length(to_hex(geid * 1000003 + line))) || repeat('0', length(to_hex(geid * 1000003 + line))))::HUGEINT)::VARCHAR AS number
        FROM v WHERE geid % 15 = 13""",
    "value_nodes": f"{_NODES} SELECT geid, node, parent, pos, kind, shown FROM c",
    "struct_fields": f"{_VALUES} SELECT geid, ['x', 'y', 'label'][i + 1] AS name, (line + 5 + i)::VARCHAR AS shown FROM v, range(3) t(i) WHERE geid % 15 = 6",
    "dictionary_functions": f"""{_WITH}, f AS (SELECT 'fn_' || function_id AS name, min(geid) AS first_geid FROM trace WHERE kind = 'Call' GROUP BY 1 UNION ALL SELECT '<toplevel>', -1)
        SELECT name, first_geid, row_number() OVER (ORDER BY first_geid) - 1 AS id FROM f""",
    "dictionary_types": f"""{_WITH}, f AS (SELECT 'T' || geid % 34 % 20 AS name, min(geid) AS first_geid, min(geid) % 34 AS kind FROM trace WHERE kind = 'Value' GROUP BY 1
        UNION ALL SELECT 'None', -1, {_NUMBER["None"]}) SELECT name, first_geid, kind, row_number() OVER (ORDER BY first_geid) - 1 AS id FROM f""",
    "dictionary_variables": f"""{_WITH}, f AS (SELECT 'v' || function_id AS name, min(geid) AS first_geid FROM trace WHERE kind = 'Value' GROUP BY 1)
        SELECT name, first_geid, row_number() OVER (ORDER BY first_geid) - 1 AS id FROM f""",
    "step_values_json": f"""{_STEPPED} SELECT step_geid, '[' || string_agg('{{"varname_id":' || function_id || ',"type":"' || {_TYPE} || '","value":"' || {_QUOTED} || '"}}', ',' ORDER BY geid) || ']' AS json
        FROM st WHERE kind = 'Value' AND step_geid IS NOT NULL GROUP BY 1""",
    "call_fields": f"{_KEYS} SELECT * FROM called",
    "call_args": f"{_WITH}, {_ARGS} SELECT call_geid, i, variable_id, shown FROM args",
    "call_arg_counts": f"{_WITH}, {_ARGS} SELECT geid AS call_geid, count(args.i) AS n FROM trace LEFT JOIN args ON call_geid = geid WHERE kind = 'Call' GROUP BY 1",
    "call_json": f"""{_KEYS}, {_ARGS}, j AS (SELECT call_geid, string_agg('{{"variable_id":' || variable_id || ',"value":"' || {_QUOTED} || '"}}', ',' ORDER BY i) AS a FROM args GROUP BY 1)
        SELECT call_key, '{{"function_id":' || function_id || ',"parent_key":' || parent_key || ',"depth":' || depth || ',"children_count":' || children_count || ',"args":[' || coalesce(a, '') || ']}}' AS json
        FROM called LEFT JOIN j ON j.call_geid = called.call_geid""",
    "calls_without_their_step": f"""{_WITH}, b AS (SELECT c.geid, c.function_id, p.kind AS before, p.line AS was FROM (SELECT * FROM trace WHERE kind = 'Call') c
        ASOF LEFT JOIN (SELECT * FROM trace WHERE kind <> 'Value') p ON c.thread_id = p.thread_id AND c.geid > p.geid)
        SELECT geid AS call_geid, before FROM b WHERE NOT coalesce(before = 'Step' AND was // 10 = function_id, false)""",
    "exec_stream_json": f"""{_EXEC} SELECT row_number() OVER (ORDER BY geid, part) - 1 AS n,
        CASE part WHEN 1 THEN '{{"kind":"step","path_id":' || path_id || ',"line":' || line || '}}' ELSE '{{"kind":"thread_switch","thread_id":' || thread_id || '}}' END AS json FROM ex""",
    "stream_counts": f"""{_EXEC} SELECT 'calls' AS what, count(*) FILTER (kind = 'Call') AS n FROM trace UNION ALL SELECT 'events', count(*) FILTER (kind = 'Event') FROM trace
        UNION ALL SELECT 'paths', count(DISTINCT path_id) FROM trace UNION ALL SELECT 'functions', count(DISTINCT function_id) FILTER (kind = 'Call') + 1 FROM trace
        UNION ALL SELECT 'variables', count(DISTINCT function_id) FILTER (kind = 'Value') FROM trace UNION ALL SELECT 'entries', count(*) FROM ex
        UNION ALL SELECT 'types', count(DISTINCT geid % 34 % 20) FILTER (kind = 'Value') + 1 FROM trace""",
    "event_fields": f"{_IO} SELECT i, kind, log_kind, step_id, data FROM io",
    "event_json": f"""{_IO} SELECT i, '{{"kind":' || kind || coalesce(',"step_id":' || step_id, '') || ',"size":' || length(data) || '}}' AS json FROM io""",
    "place_history": f"""{_WITH}, h AS (SELECT line % 50 AS place, geid, kind, lead(geid) OVER w AS to_geid, lead(kind) OVER w AS next FROM trace WHERE kind IN ('Value', 'Event') WINDOW w AS (PARTITION BY line % 50 ORDER BY geid))
        SELECT place, row_number() OVER (PARTITION BY place ORDER BY geid) - 1 AS version, geid AS from_geid, to_geid, next = 'Event' AS dropped FROM h WHERE kind = 'Value'""",
    "asm_lines": f"{_WITH}, l AS (SELECT geid, string_split(regexp_replace(content, '[{{}}\":]', '', 'g'), ' ') AS x FROM trace WHERE kind = 'Event') SELECT geid, i::INT AS i, x[i + 1] AS instruction FROM l, range(len(x)) t(i)",
    "recordings": "SELECT c_custkey, c_name AS program, '/w/' || c_custkey AS workdir, 2 AS n_args, c_nationkey::VARCHAR AS last_arg FROM customer",
    "rate_percentiles": f"""{_WITH}, h AS (SELECT path_id, line, count(*) AS hits FROM trace WHERE kind = 'Step' GROUP BY 1, 2)
        SELECT path_id, line, rank() OVER (PARTITION BY path_id ORDER BY hits DESC) AS rank, ntile(4) OVER w AS quarter,
               nth_value(line, 3) OVER (PARTITION BY path_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third_line,
               (sum(hits) OVER (PARTITION BY path_id ORDER BY line RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))::BIGINT AS around FROM h WINDOW w AS (PARTITION BY path_id ORDER BY line)""",
    "approximate_lines": f"{_WITH} SELECT kind, true AS close, quantile_disc(line, 0.5) AS middle FROM trace GROUP BY kind",
}
