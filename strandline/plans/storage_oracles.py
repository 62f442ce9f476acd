"""DuckDB SQL twins of the storage queries: the rules over the numbers that the configurations and manifests are made of."""

from __future__ import annotations

_CONFIG = "WITH c AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_suppkey % 4 <> 0 AS direct, s_suppkey % 6 <> 0 AS lease FROM supplier)"
_RULES = {
    "schema": "k % 11 = 0", "tenant": "k % 7 = 0", "max_segment_bytes": "nation = 0", "block_range_bytes": "k % 13 = 0", "shard_count": "k % 3 = 0 AND k % 4 = 0",
    "replicas": "k % 3 = 0 OR k % 5 < k % 3", "retention": "nation > 12", "lease": "direct AND NOT lease", "lease_endpoint": "direct AND lease AND k % 13 = 1",
    "lease_organization": "direct AND lease AND k % 13 = 2", "lease_session": "direct AND lease AND k % 13 = 3", "lease_session_kind": "direct AND lease AND k % 13 = 4",
    "lease_credential": "direct AND lease AND k % 13 = 5", "servers": "direct AND k % 19 = 0", "server_id": "direct AND k % 19 <> 0 AND k % 31 = 0",
    "server_endpoint": "direct AND k % 19 <> 0 AND k % 17 IN (0, 1)", "pool_empty": "direct AND k % 5 <> 3 AND k % 11 = 4",
    "pool_server": "direct AND (k % 19 = 0 AND (k % 5 <> 1 OR k % 5 <> 2 OR (k % 5 <> 3 AND k % 11 <> 4)) OR k % 5 <> 1 AND k % 7 = 2 OR k % 5 <> 2 AND k % 31 = 0)",
    "artifact_pool": "direct AND NOT (k % 4 = 0 AND k % 5 <> 1 OR k % 4 = 1 AND k % 5 <> 2 OR k % 4 = 2 AND k % 5 <> 3)",
    "pool_for_ctfs": "direct AND k % 5 = 1", "pool_for_manifest": "direct AND k % 5 = 2", "pool_for_materialized_artifact": "direct AND k % 5 = 3",
}
_LINES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS n, l_orderkey % 4 AS kind, l_orderkey AS recording, l_partkey AS p, l_suppkey AS s FROM lineitem),
r AS (SELECT o_orderkey AS recording, o_orderkey % 4 AS kind, coalesce(max(n), 0) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, CASE kind WHEN 1 THEN 1 ELSE n END + (recording % 9 = 0)::INT AS total FROM r WHERE n > 0 OR kind <> 1)"""
_OBJECT = "[CASE WHEN s % 19 = 0 THEN 'object_id' END, CASE WHEN p % 23 = 0 THEN 'uri' END, CASE WHEN s % 7 = 0 OR floor(l_quantity) <= 0 THEN 'size' END, CASE WHEN p % 29 = 0 THEN 'sha256' END, CASE WHEN p % 31 = 0 THEN 'upload' END]"
_SHARDED = f"""WITH {_LINES}, sh AS (SELECT l.*, h.i AS shard_index, 64 * h.i AS block_start, CASE WHEN h.i = 0 THEN 63 WHEN p % 37 = 0 THEN 60 ELSE 63 + 10 * l_linenumber END AS block_end,
  CASE WHEN s % 19 = 0 THEN ' ' ELSE 'o' || p || '-' || s END AS name, s % 19 = 0 AS nameless FROM l JOIN orders ON o_orderkey = l_orderkey, (VALUES (0), (1)) h(i) WHERE kind = 3 AND p % 43 <> 0),
asked AS (SELECT recording, pos AS segment, recording * 7 % 140 AS block FROM l JOIN orders ON o_orderkey = l_orderkey WHERE kind = 3)"""
_FIRST = """hit AS (SELECT a.recording, a.segment::INT AS segment, a.block, arg_min(struct_pack(i := shard_index::INT, p := p, name := name, nameless := nameless), shard_index) AS x
  FROM asked a JOIN sh ON sh.recording = a.recording AND sh.pos = a.segment AND a.block BETWEEN block_start AND block_end GROUP BY ALL)"""

ORACLES = {
    "config_violations": f"{_CONFIG}, v AS (SELECT k AS config, unnest([{', '.join(f'''CASE WHEN {c} THEN '{r}' END''' for r, c in _RULES.items())}]) AS rule FROM c) SELECT * FROM v WHERE rule IS NOT NULL",
    "first_servers": f"""{_CONFIG}, p AS (
        SELECT k, 'ctfs' AS purpose, 'pool0' AS pool, CASE WHEN k % 7 = 2 THEN 'srv1' ELSE 'srv0' END AS server FROM c WHERE direct AND k % 5 <> 1
        UNION ALL SELECT k, 'manifest', 'pool1', 'srv1' FROM c WHERE direct AND k % 5 <> 2
        UNION ALL SELECT k, 'materialized_artifact', 'pool2', CASE WHEN k % 11 <> 4 THEN 'srv0' END FROM c WHERE direct AND k % 5 <> 3)
        SELECT k AS config, purpose, pool, server, CASE WHEN k % 19 = 0 OR server IS NULL OR (server = 'srv1' AND k % 31 = 0) THEN NULL
          WHEN server = 'srv0' THEN CASE k % 17 WHEN 0 THEN '' ELSE 'https://h0.example/' || k END ELSE CASE k % 17 WHEN 1 THEN '' ELSE 'https://h1.example/' || k END END AS base_url FROM p""",
    "finalize_violations": f"""{_SHARDED}, v AS (
        SELECT recording, NULL::INT AS segment, unnest([CASE WHEN kind = 0 AND n = 0 THEN 'no_artifacts' END, CASE WHEN kind = 1 AND total <> 1 THEN 'one_slice' END,
          CASE WHEN kind > 1 AND (total = 0 OR n = 0) THEN 'no_segments' END, CASE WHEN kind > 1 AND total > 0 AND n > 0 AND n <> total THEN 'slices' END]) AS rule FROM m
        UNION ALL SELECT recording, NULL, 'object_id' FROM m WHERE kind = 0 AND n = 0 UNION ALL SELECT recording, NULL, 'uri' FROM m WHERE kind = 0 AND n = 0
        UNION ALL SELECT recording, NULL, 'size' FROM m WHERE kind = 0 AND n = 0 UNION ALL SELECT recording, NULL, 'sha256' FROM m WHERE kind = 0 AND n = 0
        UNION ALL SELECT recording, NULL, 'upload' FROM m WHERE kind = 0 AND n = 0
        UNION ALL SELECT l.recording, l.pos::INT, unnest([CASE WHEN p % 17 = 0 THEN 'index' END, CASE WHEN l.kind = 3 AND p % 43 = 0 THEN 'no_shards' END]) FROM l JOIN m USING (recording) WHERE l.kind > 1
        UNION ALL SELECT recording, pos::INT, unnest([CASE WHEN block_end < block_start THEN 'block_range' END, CASE WHEN p % 41 = 0 THEN 'no_replicas' END]) FROM sh
        UNION ALL SELECT l.recording, NULL, unnest({_OBJECT}) FROM l JOIN m USING (recording) WHERE l.kind <= 1 AND pos = 0
        UNION ALL SELECT l.recording, NULL, unnest({_OBJECT}) FROM l JOIN m USING (recording) WHERE l.kind = 0
        UNION ALL SELECT l.recording, l.pos::INT, unnest({_OBJECT}) FROM l JOIN m USING (recording) WHERE l.kind = 2
        UNION ALL SELECT sh.recording, sh.pos::INT, unnest({_OBJECT}) FROM sh, range(2) WHERE p % 41 <> 0)
        SELECT recording, segment, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY ALL""",
    "next_uploads": """WITH t AS (SELECT l_partkey * 1000 + l_suppkey AS object, l_returnflag <> 'N' AS ends, row_number() OVER (PARTITION BY l_partkey * 1000 + l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem)
        SELECT lpad(object::VARCHAR, 12, '0') AS key, count(*) AS attempts FROM t GROUP BY object HAVING NOT bool_or(ends) ORDER BY key LIMIT 20""",
    "first_recordings": """WITH c AS (SELECT c_custkey, 1700000000000 + c_custkey * 7919 % 100003 AS millis FROM customer), h AS (SELECT *, lpad(lower(to_hex(millis)), 12, '0') AS x FROM c)
        SELECT c_custkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-7000-8000-' || lpad(lower(to_hex(c_custkey)), 12, '0') AS recording, millis, true AS valid FROM h ORDER BY recording LIMIT 10""",
    "segment_counts": f"WITH {_LINES} SELECT recording, ['materialized_artifact', 'single_ctfs', 'split_ctfs', 'sharded_split_ctfs'][kind + 1] AS kind, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE n END::INT AS segments FROM m",
    "geid_ranges": f"""WITH {_LINES} SELECT l.recording, min(100 * pos + 1) AS geid_start, max(100 * pos + 90 + l_linenumber) AS geid_end, sum(89 + l_linenumber)::BIGINT AS stated, sum(90 + l_linenumber)::BIGINT AS events
        FROM l JOIN m USING (recording) WHERE l.kind > 1 GROUP BY 1""",
    "finalize_report": f"""{_SHARDED} SELECT recording, sum(CASE WHEN p % 41 = 0 OR s % 7 = 0 THEN 0 ELSE 2 * floor(l_quantity) END)::BIGINT AS bytes_written, sum(CASE WHEN p % 41 = 0 THEN 0 ELSE 2 END)::BIGINT AS replicas,
        count(*) AS shards FROM sh GROUP BY 1""",
    "manifest_blocks": f"{_SHARDED}, {_FIRST} SELECT recording, segment, block, x.i AS shard_index, CASE WHEN x.p % 41 = 0 THEN NULL WHEN x.nameless THEN ' ' ELSE x.name || '-a' END AS object_id FROM hit",
    "replica_failover": f"""{_SHARDED}, {_FIRST} SELECT recording, segment, CASE WHEN x.p % 41 = 0 THEN NULL WHEN x.nameless THEN ' ' WHEN (length(x.name) + 2) % 3 = 0 THEN x.name || '-b' ELSE x.name || '-a' END AS object_id FROM hit""",
    "finalize_attempts": "SELECT l_suppkey || '/' || l_linenumber AS key, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_partkey)) AS recording, count(*) AS attempts FROM lineitem GROUP BY 1",
    "upload_states": """WITH t AS (SELECT l_partkey * 1000 + l_suppkey AS object, CASE l_returnflag WHEN 'A' THEN 'uploaded' WHEN 'N' THEN 'retryable_failure' ELSE 'fatal_failure' END AS state,
          row_number() OVER (PARTITION BY l_partkey * 1000 + l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem),
        e AS (SELECT object, min(i) FILTER (state <> 'retryable_failure') AS ended FROM t GROUP BY 1)
        SELECT object, arg_max(state, i) AS state, count(*) AS attempts FROM t JOIN e USING (object) WHERE ended IS NULL OR i <= ended GROUP BY 1""",
    "content_mismatches": """SELECT doc_id, 'digest' AS rule FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT doc_id, 'empty' FROM documents WHERE coalesce(text, '') = ''""",
    "object_uris": "SELECT p_partkey, 'https://h.example/' || url_encode('rec ' || p_partkey || '/é&' || p_partkey % 7) AS uri, 'rec ' || p_partkey || '/é&' || p_partkey % 7 AS key FROM part",
}
#: The same breaches, whatever segment they are in.
ORACLES["manifest_texts"] = f"SELECT recording, rule, sum(n)::BIGINT AS n FROM ({ORACLES['finalize_violations']}) GROUP BY 1, 2"
