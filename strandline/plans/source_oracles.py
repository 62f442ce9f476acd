"""DuckDB SQL twins of the format queries: the trace itself, as nothing may be lost on the way."""

from __future__ import annotations

from strandline.plans.adapter import TRACE_SQL
from strandline.plans.value_oracles import SHOWN

_EVENTS = f"""WITH {TRACE_SQL}, ev AS (SELECT geid, kind, CASE kind WHEN 'Step' THEN path_id END AS path_id, CASE kind WHEN 'Step' THEN line END AS line, CASE kind WHEN 'Call' THEN function_id END AS function_id,
  CASE kind WHEN 'Value' THEN function_id END AS variable_id, CASE kind WHEN 'Event' THEN (line % 14)::INT END AS log_kind, CASE kind WHEN 'Event' THEN content END AS content,
  CASE WHEN kind IN ('Value', 'Return') THEN {SHOWN} END AS shown FROM trace)"""

_REGIONS = """WITH r AS (SELECT s_nationkey::BIGINT AS recording, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS region, s_suppkey * 131072 AS address,
  4096 * (1 + s_suppkey % 30) AS size, 'bin' || s_suppkey % 5 AS binary, 512 * s_suppkey AS file_offset, s_suppkey % 8 AS permissions FROM supplier)"""

ORACLES = {
    "binary_stream": f"{_EVENTS} SELECT * FROM ev",
    "cbor_stream": f"{_EVENTS} SELECT * FROM ev",
    "stream_seek": f"{_EVENTS} SELECT * FROM ev WHERE geid >= 4050 AND geid < 4150",
    "stream_chunks": f"{_EVENTS}, i AS (SELECT geid, (row_number() OVER (ORDER BY geid) - 1) // 4096 AS chunk_id FROM ev) SELECT chunk_id, min(geid) AS first_geid, count(*) AS event_count FROM i GROUP BY 1",
    "json_lines": f"""{_EVENTS} SELECT row_number() OVER (ORDER BY geid) - 1 AS position, kind, path_id, line, variable_id, shown FROM ev WHERE kind IN ('Step', 'Value')""",
    "detected_formats": "SELECT p_partkey, ['cbor-zstd', 'binary-v0', 'container', 'json', NULL][p_partkey % 5 + 1] AS format FROM part",
    "shortened_texts": "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS shown FROM documents",
    "labels_and_languages": """SELECT p_partkey, [0, 1, 2, 3, 4, NULL][p_partkey % 6 + 1] AS kind, ['python', 'javascript', 'ruby', 'javascript', NULL][p_partkey % 5 + 1] AS language,
        CASE WHEN p_partkey % 4 IN (1, 2) THEN 'application/json' ELSE 'application/octet-stream' END AS content_type FROM part""",
    "mapped_regions": f"{_REGIONS} SELECT * FROM r",
    "address_regions": f"""{_REGIONS}, a AS (SELECT o_orderkey, (o_custkey % 25)::BIGINT AS recording, o_orderkey % 120 * 131072 + o_orderkey * 37 % 131072 AS address FROM orders)
        SELECT a.o_orderkey, a.recording, a.address, r.region, r.binary, a.address - r.address AS "offset" FROM a LEFT JOIN r ON r.recording = a.recording AND a.address >= r.address AND a.address < r.address + r.size""",
    "recorded_files": """WITH p AS (SELECT *, p_partkey % 3 AS t FROM part)
        SELECT p_partkey // 300 AS recording, 'f' || p_partkey AS name, ['binary', 'debug_symbol', 'source_file'][t + 1] AS kind, (p_partkey % 4)::INT AS flags,
          repeat(lpad(lower(to_hex(p_partkey % 251)), 2, '0'), t::INT) AS build_id, '/usr/é/' || p_partkey AS path, CASE t WHEN 1 THEN 'f' || (p_partkey - 1) END AS binary,
          CASE t WHEN 1 THEN '/usr/é/' || (p_partkey - 1) END AS binary_path, CASE t WHEN 2 THEN length('/src/' || p_partkey) * (p_partkey % 40) END::INT AS folder_length FROM p""",
    "events_at_offset": f"""{_EVENTS}, o AS (SELECT geid, kind, coalesce(sum(strlen(content) + 17) OVER (ORDER BY geid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM trace)
        SELECT * FROM o WHERE byte_offset >= 5000 AND byte_offset < 9000""",
    "appended_traces": f"{_EVENTS} SELECT geid, kind, line FROM trace UNION ALL SELECT geid + (SELECT max(geid) + 1 FROM trace), kind, line FROM trace WHERE kind = 'Step'",
}
