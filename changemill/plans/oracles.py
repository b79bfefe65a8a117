"""ANSI SQL with the same answer as each registered query, over the same derived views."""

from __future__ import annotations

from changemill.functions.types import (
    CANONICAL_NAMES,
    MAX_LENGTH_NAMES,
    SIZED_NAMES,
    SPARK_TYPES,
    TRANSLATION_DEFAULTS,
    TRANSLATIONS,
)
from changemill.plans.fixtures import TABLES, with_views

FOLDED = """
f AS (SELECT * FROM {feed} WHERE op <> 't'),
lt AS (SELECT topic, max(off) AS t_off FROM {feed} WHERE op = 't' GROUP BY topic),
r AS (SELECT f.*, row_number() OVER (PARTITION BY {keys} ORDER BY off DESC) AS rn FROM f),
w AS (SELECT r.* FROM r LEFT JOIN lt ON r.topic = lt.topic WHERE rn = 1 AND (lt.t_off IS NULL OR r.off > lt.t_off))
"""


def folded(feed: str = "feed", keys: str = "f.topic, f.user_id") -> str:
    return FOLDED.format(feed=feed, keys=keys)


def _rows(values: list[tuple]) -> str:
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in values)


# ---- Expected clauses of the sixteen DDL kinds, written out rather than parsed -------------
CLAUSE_COLUMNS = (
    "kind, clause_no, operation, column_name, new_name, type_name, length, scale, is_optional, "
    "default_value, index_name, index_columns, is_unique, is_destructive"
)
EXPECTED_CLAUSES = [
    (0, 0, "ADD_COLUMN", "a", None, "INT", None, None, True, None, None, None, None, False),
    (0, 1, "DROP_COLUMN", "b", None, None, None, None, None, None, None, None, None, True),
    (0, 2, "MODIFY_COLUMN", "c", None, "DECIMAL", 10, 2, True, None, None, None, None, False),
    (1, 0, "MODIFY_COLUMN", "c", None, "INT", None, None, False, None, None, None, None, False),
    (2, 0, "ADD_PRIMARY_KEY", None, None, None, None, None, None, None, None, "a,b", None, False),
    (3, 0, "ADD_INDEX", None, None, None, None, None, None, None, "i", "a,b", True, False),
    (3, 1, "ADD_INDEX", None, None, None, None, None, None, None, "j", "c", False, False),
    (4, 0, "RENAME_COLUMN", "x", "y", "VARCHAR", 20, None, False, None, None, None, None, False),
    (5, 0, "RENAME_COLUMN", "x", "y", None, None, None, None, None, None, None, None, False),
    (9, 0, "MODIFY_COLUMN", "z", None, "BIGINT", None, None, True, None, None, None, None, False),
    (9, 1, "ADD_CONSTRAINT", None, None, None, None, None, None, None, "k", None, None, False),
    (9, 2, "DROP_PRIMARY_KEY", None, None, None, None, None, None, None, None, None, None, True),
    (10, 0, "ADD_COLUMN", "d", None, "DATETIME", None, None, False, "now", None, None, None, False),
    (10, 1, "DROP_INDEX", None, None, None, None, None, None, None, "i", None, None, False),
    (11, 0, "MODIFY_COLUMN", "c", None, "TEXT", None, None, True, None, None, None, None, False),
    (12, 0, "NO_OP", "c", None, None, None, None, None, None, None, None, None, False),
    (12, 1, "ADD_COLUMN", "e", None, "CHARACTER VARYING", 30, None, True, None, None, None, None, False),
    (13, 0, "DROP_COLUMN", "f", None, None, None, None, None, None, None, None, None, True),
    (13, 1, "ADD_COLUMN", "g", None, "INT", None, None, True, None, None, None, None, False),
]
EXPECTED_ROUTES = {
    0: "parse_alter", 1: "parse_alter", 2: "parse_alter", 3: "parse_alter", 4: "parse_alter", 5: "parse_alter",
    6: "skipped", 7: "skipped", 8: "ignored", 9: "parse_alter", 10: "parse_alter", 11: "parse_alter",
    12: "parse_alter", 13: "parse_alter", 14: "dead_letter", 15: "skipped",
}
CLAUSES = f"expected AS (SELECT * FROM (VALUES {_rows(EXPECTED_CLAUSES)}) AS v({CLAUSE_COLUMNS}))"
GATED = f"""
{CLAUSES},
ops AS (SELECT d.ddl_id, e.clause_no, d.tbl, e.operation, e.is_destructive,
               EXISTS (SELECT 1 FROM expected p WHERE p.kind = e.kind AND p.clause_no < e.clause_no AND p.is_destructive) AS after_wait
        FROM ddl_text d JOIN expected e ON d.ddl_id % 16 = e.kind),
gated AS (SELECT ddl_id, clause_no, tbl, operation,
                 CASE WHEN tbl NOT IN (SELECT tbl FROM ddl_targets) THEN 'skipped'
                      WHEN operation IN ('NO_OP', 'UNKNOWN') THEN 'ignored'
                      WHEN after_wait THEN 'blocked' WHEN is_destructive THEN 'pending_approval' ELSE 'apply' END AS status
          FROM ops)"""

CANONICAL_ROWS = _rows([(s, n, c) for s, names in CANONICAL_NAMES.items() for n, c in names.items()])
TRANSLATION_ROWS = _rows([(s, t, n, r) for (s, t), names in TRANSLATIONS.items() for n, r in names.items()])
SIZED_ROWS = _rows([(s, t, n) for (s, t), found in SIZED_NAMES.items() for n in found])
MAX_ROWS = _rows([(s, t, n, r) for (s, t), found in MAX_LENGTH_NAMES.items() for n, r in found.items()])
SPARK_ROWS = _rows(list(SPARK_TYPES.items()))


def _translated(target: str, exact: str) -> str:
    defaults = " ".join(
        f"WHEN '{s}' THEN " + (f"'{d}'" if d else "upper(base)") for (s, t), d in TRANSLATION_DEFAULTS.items() if t == target
    )
    return f"""
      (SELECT CASE WHEN p.system = '{target}' THEN upper(p.type_name)
                   WHEN m.unbounded IS NOT NULL AND p.len = -1 THEN m.unbounded
                   WHEN z.sized IS NOT NULL AND p.len > 0 THEN concat(q.name, '(', p.len, ')')
                   WHEN q.name = '{exact}' AND p.len > 0 AND p.sc > 0 THEN concat(q.name, '(', p.len, ',', p.sc, ')')
                   WHEN q.name = '{exact}' AND p.len > 0 THEN concat(q.name, '(', p.len, ')')
                   WHEN p.system = 'postgresql' AND q.name = 'VARCHAR' THEN 'VARCHAR(255)'
                   ELSE q.name END
       FROM (SELECT coalesce((SELECT result FROM trans t WHERE t.system = p.system AND t.target = '{target}' AND t.base = p.base),
                             CASE p.system {defaults} END) AS name) q
       LEFT JOIN sizes z ON z.system = p.system AND z.target = '{target}' AND z.sized = q.name
       LEFT JOIN maxes m ON m.system = p.system AND m.target = '{target}' AND m.name = q.name) AS {target}_type"""


SIMILAR = """
similar_types AS (SELECT * FROM (VALUES ('INT','INT'),('INTEGER','INT'),('INT4','INT'),('BIGINT','BIGINT'),('INT8','BIGINT'),
  ('SMALLINT','SMALLINT'),('INT2','SMALLINT'),('VARCHAR','VARCHAR'),('CHARACTER VARYING','VARCHAR'),('TEXT','VARCHAR'),
  ('TIMESTAMP','TIMESTAMP'),('DATETIME','TIMESTAMP'),('DECIMAL','NUMERIC'),('NUMERIC','NUMERIC')) AS v(name, grp))"""

_ORDERS = {
    "insert_first": """
replayed AS (SELECT *, lag(op) OVER (PARTITION BY c_custkey ORDER BY off) AS before,
                    max(CASE WHEN op = 'd' THEN off END) OVER (PARTITION BY c_custkey ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deleted,
                    max(CASE WHEN op = 'd' THEN off END) OVER (PARTITION BY c_custkey) AS last_delete FROM customer_inserts),
marked AS (SELECT i.*, CASE WHEN c.c_custkey IS NOT NULL AND i.deleted IS NULL THEN 'key_exists'
                            WHEN i.before <> 'd' THEN 'duplicate_in_batch' END AS reason
           FROM replayed i LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) c ON i.c_custkey = c.c_custkey WHERE i.op <> 'd')""",
    "chunks": """
chunks AS (SELECT o_orderkey, o_totalprice, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1024) AS BIGINT) AS chunk FROM orders)""",
}
HEALTHY = """(source_state IN ('RUNNING', 'PAUSED') AND NOT source_task_failed)"""
SINK_HEALTHY = """(sink_state IN ('RUNNING', 'PAUSED') AND NOT sink_task_failed)"""
HEALTH = f"""CASE WHEN {HEALTHY} AND {SINK_HEALTHY} THEN 'healthy'
  WHEN ({HEALTHY} OR source_state IN ('PAUSED', 'FAILED') OR source_task_failed)
   AND ({SINK_HEALTHY} OR sink_state IN ('PAUSED', 'FAILED') OR sink_task_failed) THEN 'degraded' ELSE 'unhealthy' END"""
LE = [("0.01", 10000), ("0.05", 50000), ("0.1", 100000), ("0.5", 500000), ("1.0", 1000000), ("5.0", 5000000), ("10.0", 10000000)]

SQL: dict[str, str] = {
    "current_state": f"WITH {folded()} SELECT topic, user_id, event_type, value, off FROM r WHERE rn = 1 AND op <> 'd'",
    "truncate_aware_state": f"WITH {folded()} SELECT topic, user_id, event_type, value, off FROM w WHERE op <> 'd'",
    "latest_change": f"WITH {folded()} SELECT topic, user_id, event_type, value, off, op FROM r WHERE rn = 1",
    "soft_delete_state": """
WITH f AS (SELECT * FROM feed WHERE op <> 't'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, user_id ORDER BY off DESC) AS rn FROM f) WHERE rn = 1),
image AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, user_id ORDER BY off DESC) AS rn FROM f WHERE op <> 'd') WHERE rn = 1)
SELECT l.topic, l.user_id, i.event_type, i.value, l.off, l.op = 'd' AS __deleted
FROM last l LEFT JOIN image i ON l.topic = i.topic AND l.user_id = i.user_id""",
    "insert_mode_state": f"""WITH {_ORDERS['insert_first']}
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM customer_inserts WHERE op = 'd')
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM marked
WHERE reason IS NULL AND (last_delete IS NULL OR off > last_delete)""",
    "insert_mode_rejects": f"WITH {_ORDERS['insert_first']} SELECT c_custkey, off, reason FROM marked WHERE reason IS NOT NULL",
    "update_mode_state": """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY off DESC) AS rn FROM customer_inserts WHERE op <> 'd') WHERE rn = 1)
SELECT c.c_custkey, CASE WHEN l.c_custkey IS NULL THEN c.c_name ELSE l.c_name END AS c_name,
       CASE WHEN l.c_custkey IS NULL THEN c.c_nationkey ELSE l.c_nationkey END AS c_nationkey,
       CASE WHEN l.c_custkey IS NULL THEN c.c_acctbal ELSE l.c_acctbal END AS c_acctbal,
       CASE WHEN l.c_custkey IS NULL THEN c.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment
FROM customer c LEFT JOIN l ON c.c_custkey = l.c_custkey
WHERE c.c_custkey NOT IN (SELECT c_custkey FROM customer_inserts WHERE op = 'd')""",
    "merge_customer": """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY off DESC) AS rn FROM customer_changes) WHERE rn = 1)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l)
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM l WHERE op <> 'd'""",
    "key_mode_rows": "SELECT topic AS __topic, part AS __partition, off AS __offset, op, user_id FROM feed",
    "routed_feed": """
SELECT f.topic, f.off, f.op, f.row_key,
       CASE WHEN f.topic LIKE '%.shop.orders' THEN 'all_orders'
            ELSE concat(split_part(f.topic, '.', len(string_split(f.topic, '.')) - 1), '_', split_part(f.topic, '.', len(string_split(f.topic, '.')))) END AS target_table
FROM multi_feed f WHERE f.topic NOT LIKE '%ddl_events' AND f.topic NOT LIKE '%debezium_signal'""",
    "multi_table_state": f"""
WITH listed AS (SELECT * FROM multi_feed WHERE topic LIKE '%.shop.users%' OR topic LIKE '%.shop.orders'),
{folded('listed', 'f.topic, f.row_key')}
SELECT CASE WHEN topic LIKE '%.orders' THEN 'all_orders' ELSE concat('shop_', split_part(topic, '.', 3)) END AS target_table,
       row_key, label, off
FROM w WHERE op <> 'd'""",
    "without_truncates": "SELECT topic, off, op, user_id FROM feed WHERE op <> 't'",
    "topic_names": """
WITH p AS (SELECT topic, count(*) AS n, string_split(topic, '.') AS s FROM multi_feed GROUP BY topic)
SELECT topic, n, s[1] AS prefix, CASE WHEN s[1] LIKE 'client_1_db_3%' THEN 3 ELSE 2 END AS db_id, s[-2] AS source_schema, s[-1] AS source_table,
       concat(s[-2], '_', s[-1]) AS default_target,
       concat(s[1], '.warehouse.', array_to_string(s[3:], '.')) AS rerouted
FROM p""",
    "qualified_names": """
WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'app' END AS sch,
                  c_custkey % 5 = 0 AS own, concat('t', c_custkey) AS bare FROM customer)
SELECT c_custkey,
       CASE k WHEN 2 THEN concat('p.shop.', coalesce(sch, 'dbo'), '.', bare) WHEN 3 THEN concat('p.', coalesce(sch, 'CDC'), '.', bare)
              ELSE concat('p.shop.', bare) END AS topic,
       CASE WHEN k = 0 THEN concat('shop.', bare) WHEN own THEN concat('own.', bare)
            ELSE concat(coalesce(sch, CASE k WHEN 1 THEN 'public' WHEN 2 THEN 'dbo' ELSE 'CDC' END), '.', bare) END AS include_name,
       CASE k WHEN 0 THEN CASE WHEN own THEN concat('own.', bare) ELSE concat('shop.', bare) END
              WHEN 1 THEN CASE WHEN own THEN concat('own.', bare) ELSE concat(coalesce(sch, 'public'), '.', bare) END
              WHEN 2 THEN CASE WHEN own THEN concat('shop.own.', bare) ELSE concat('shop.', coalesce(sch, 'dbo'), '.', bare) END
              ELSE upper(CASE WHEN own THEN concat('shop.own.', bare) ELSE concat('shop.', coalesce(sch, 'SHOP'), '.', bare) END) END AS snapshot_name,
       concat('my_source_', CASE WHEN own THEN 'own' ELSE '' END, bare) AS slug
FROM c""",
    "subscription_changes": """
SELECT DISTINCT topic, 'added' AS change FROM multi_feed WHERE topic LIKE '%users_1' OR topic LIKE '%orders'
UNION ALL SELECT DISTINCT topic, 'removed' AS change FROM multi_feed WHERE topic LIKE '%ddl_events' OR topic LIKE '%debezium_signal'""",
    "capture_events": """
SELECT event_id, off, schema_name, split_part(object_name, '.', 2) AS tbl
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off) AS rn FROM capture_rows)
WHERE rn = 1 AND NOT processed AND schema_name <> 'pg_catalog'""",
    "conformed_rows": """
SELECT off, TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_custkey AS BIGINT) AS o_custkey,
       CAST(TRY_CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS o_totalprice,
       TRY_CAST(o_orderdate AS TIMESTAMP) AS o_orderdate
FROM orders_text
WHERE o_totalprice <> 'n/a' AND (o_orderdate LIKE '0000-00-00%' OR TRY_CAST(o_orderdate AS TIMESTAMP) IS NOT NULL)""",
    "conform_rejects": """
WITH m AS (SELECT off, o_totalprice = 'n/a' AS p, o_orderdate LIKE '1996-13-45%' AS d FROM orders_text)
SELECT off, CASE WHEN p AND d THEN 'o_totalprice,o_orderdate' WHEN p THEN 'o_totalprice' ELSE 'o_orderdate' END AS rejects
FROM m WHERE p OR d""",
    "batch_results": """
WITH m AS (SELECT o_totalprice = 'n/a' OR o_orderdate LIKE '1996-13-45%' AS bad FROM orders_text)
SELECT count(*) FILTER (NOT bad) AS processed, count(*) FILTER (bad) AS errors FROM m""",
    "truncates_due": """
SELECT p.topic, p.part, p.off, c.committed FROM truncates_pending p JOIN sink_committed c ON p.topic = c.topic AND p.part = c.part
WHERE c.committed >= 0 AND c.committed > p.off""",
    "commit_positions": """
WITH waiting AS (SELECT p.topic, p.part, min(p.off) AS off FROM truncates_pending p
                 LEFT JOIN sink_committed c ON p.topic = c.topic AND p.part = c.part
                 WHERE c.committed IS NULL OR c.committed <= p.off GROUP BY p.topic, p.part)
SELECT w.topic, w.part, least(w.position, coalesce(x.off, w.position)) AS commit_position
FROM watch_positions w LEFT JOIN waiting x ON w.topic = x.topic AND w.part = x.part""",
    "queued_truncates": """
SELECT concat('cfg_', user_id) AS pipeline, split_part(topic, '.', 3) AS tbl, max(off) AS off FROM feed WHERE op = 't'
GROUP BY user_id, topic""",
    "drainable_truncates": """
WITH q AS (SELECT concat('cfg_', user_id) AS pipeline, split_part(topic, '.', 3) AS tbl, max(off) AS off FROM feed WHERE op = 't'
           GROUP BY user_id, topic)
SELECT q.* FROM q JOIN configs c ON q.pipeline = c.pipeline JOIN statuses s ON c.source_name = s.name JOIN statuses k ON c.sink_name = k.name
WHERE s.state = 'RUNNING' AND k.state = 'RUNNING'""",
    "chunk_snapshot_merge": f"""
WITH {_ORDERS['chunks']},
reads AS (SELECT c.o_orderkey, c.o_totalprice, c.chunk * 100 + 99 AS off, 'r' AS op FROM chunks c
          WHERE NOT EXISTS (SELECT 1 FROM orders_log l WHERE l.o_orderkey = c.o_orderkey AND l.off >= c.chunk * 100 AND l.off < c.chunk * 100 + 100)),
u AS (SELECT o_orderkey, o_totalprice, off, op FROM reads UNION ALL SELECT o_orderkey, o_totalprice, off, op FROM orders_log),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY off DESC) AS rn FROM u)
SELECT o_orderkey, o_totalprice, off, op FROM r WHERE rn = 1 AND op <> 'd'""",
    "chunk_sizes": f"WITH {_ORDERS['chunks']} SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM chunks GROUP BY chunk",
    "snapshot_progress": """
WITH t AS (SELECT pipeline, kind, tbl, sum(rows) AS rows, min(started_at) AS s, max(finished_at) AS e, bool_or(is_last) AS done
           FROM chunk_completions GROUP BY pipeline, kind, tbl),
cur AS (SELECT pipeline, kind, tbl FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, kind ORDER BY e DESC, tbl DESC) AS rn FROM t) WHERE rn = 1),
k AS (SELECT pipeline, kind, count(*) FILTER (done) AS done, sum(rows) AS rows, min(s) AS s, max(e) AS e FROM t GROUP BY pipeline, kind),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY kind = 'incremental' DESC) AS rn FROM k) WHERE rn = 1),
n AS (SELECT pipeline, count(*) AS total FROM snapshot_tables GROUP BY pipeline)
SELECT n.pipeline, p.kind, n.total AS total_tables, greatest(n.total - coalesce(p.done, 0), 0) AS remaining_tables,
       least(coalesce(p.done, 0), n.total) AS completed_tables, CAST(coalesce(p.rows, 0) AS BIGINT) AS rows_scanned,
       coalesce(CAST(floor(epoch_us(p.e) / 1e6 - epoch_us(p.s) / 1e6) AS BIGINT), 0) AS duration_seconds,
       CASE WHEN n.total > coalesce(p.done, 0) THEN cur.tbl END AS current_table,
       n.total <= coalesce(p.done, 0) OR (p.kind IS NULL AND n.pipeline IN (SELECT pipeline FROM streaming_pipelines)) AS is_completed
FROM n LEFT JOIN p ON n.pipeline = p.pipeline LEFT JOIN cur ON p.pipeline = cur.pipeline AND p.kind = cur.kind""",
    "resynced_state": """
WITH u AS (SELECT o_orderkey, o_totalprice, CAST(500 AS BIGINT) AS off, 'r' AS op, 0 AS late FROM orders
           UNION ALL SELECT o_orderkey, o_totalprice, off, op, 1 AS late FROM orders_log WHERE off > 500),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY off DESC) AS rn FROM u)
SELECT o_orderkey, o_totalprice, off, op FROM r WHERE rn = 1 AND op <> 'd'""",
    "handover_state": """
WITH u AS (SELECT o_orderkey, o_totalprice, CAST(300 AS BIGINT) AS off, 'r' AS op FROM orders
           UNION ALL SELECT o_orderkey, o_totalprice, off, op FROM orders_log WHERE off > 300),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY off DESC) AS rn FROM u)
SELECT o_orderkey, o_totalprice, off FROM r WHERE rn = 1 AND op <> 'd'""",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}"
        for t in (*TABLES, "orders_copy")
    ),
    "compared_counts": """
SELECT m.pipeline, m.source_table, m.target_table, coalesce(s.n, -1) AS source_rows, coalesce(t.n, -1) AS target_rows,
       CASE WHEN s.tbl IS NULL THEN 'table_not_found' ELSE s.error END AS source_error,
       CASE WHEN t.tbl IS NULL THEN 'table_not_found' ELSE t.error END AS target_error,
       coalesce(s.n = t.n, false) AS in_sync
FROM sync_mapping m LEFT JOIN sync_source s ON m.source_table = s.tbl LEFT JOIN sync_target t ON m.target_table = t.tbl
WHERE m.is_enabled""",
    "sync_status": """
WITH c AS (SELECT m.pipeline, count(*) AS total, count(*) FILTER (s.n = t.n) AS same, bool_or(coalesce(t.error = 'db_unreachable', false)) AS down
           FROM sync_mapping m LEFT JOIN sync_source s ON m.source_table = s.tbl LEFT JOIN sync_target t ON m.target_table = t.tbl
           WHERE m.is_enabled GROUP BY m.pipeline),
s AS (SELECT p.*, coalesce(c.total, 0) AS total, coalesce(c.same, 0) AS same,
             CASE WHEN p.snapshot_running AND p.checked_at - p.created_at < INTERVAL 24 HOUR THEN 'snapshot_in_progress'
                  WHEN c.total IS NULL OR c.down THEN 'unable_to_check' WHEN c.total = c.same THEN 'rows_in_sync' ELSE 'not_synced' END AS status
      FROM sync_pipelines p LEFT JOIN c ON p.pipeline = c.pipeline)
SELECT pipeline, status, total AS total_count, same AS in_sync_count, total - same AS not_synced_count,
       CASE WHEN status = 'rows_in_sync' THEN checked_at ELSE last_success_at END AS last_fully_synced FROM s""",
    "decoded_changes": """
SELECT topic, off, op, user_id, CASE WHEN op <> 'd' THEN value END AS value FROM damaged_feed WHERE damage IS NULL AND op <> 't'""",
    "envelope_dead_letters": """
SELECT topic, part, off, 'decode' AS stage, damage AS error_class FROM damaged_feed WHERE damage IS NOT NULL""",
    "decimal_values": "SELECT o_orderkey, ((o_orderkey - 7000) * 13) / 100.0 AS amount FROM orders",
    "wire_times": """
SELECT event_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%H:%M:%S.%f') AS time_of_day FROM events""",
    "snapshot_requests": """
SELECT s.prefix, s.off, concat('s', s.off) AS signal_id, m.target_table
FROM signal_rows s JOIN mapping m ON m.is_enabled AND s.collection = concat(m.source_schema, '.', m.source_table)
WHERE s.signal_type = 'execute-snapshot'""",
    "snapshot_states": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY off DESC) AS rn FROM signal_rows)
SELECT prefix, CASE signal_type WHEN 'pause-snapshot' THEN 'paused' WHEN 'stop-snapshot' THEN 'stopped' ELSE 'running' END AS state, off FROM r WHERE rn = 1""",
    "history_events": """
SELECT off, db, ddl, 'event' AS outcome FROM history_rows WHERE NOT broken AND NOT is_null AND db = 'shop'
UNION ALL SELECT off, NULL AS db, NULL AS ddl, 'malformed_json' AS outcome FROM history_rows WHERE broken""",
    "table_profile": " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {c} AS columns, count(*) AS n FROM {t}"
        for t, c in {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
                     "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}.items()
    ),
    "null_counts": """
SELECT 'user_id' AS column_name, count(*) FILTER (user_id IS NULL) AS null_rows FROM evolving_feed
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL) FROM evolving_feed
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM evolving_feed
UNION ALL SELECT 'origin', count(*) FILTER (origin IS NULL) FROM evolving_feed""",
    "default_backfill": "SELECT topic, off, coalesce(event_type, 'none') AS event_type, coalesce(origin, 'unknown') AS origin FROM evolving_feed",
    "row_diff": """
SELECT o_orderkey, 'missing' AS diff, NULL AS changed_columns FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_copy)
UNION ALL SELECT o_orderkey, 'extra' AS diff, NULL AS changed_columns FROM orders_copy WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT o.o_orderkey, 'different' AS diff, 'o_totalprice' AS changed_columns FROM orders o JOIN orders_copy c ON o.o_orderkey = c.o_orderkey
WHERE o.o_totalprice <> c.o_totalprice""",
    "row_diff_summary": """
SELECT CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra'
            WHEN o.o_custkey = c.o_custkey AND o.o_orderstatus = c.o_orderstatus AND o.o_totalprice = c.o_totalprice
             AND o.o_orderdate = c.o_orderdate AND o.o_orderpriority = c.o_orderpriority THEN 'same' ELSE 'different' END AS diff, count(*) AS n
FROM orders o FULL JOIN orders_copy c ON o.o_orderkey = c.o_orderkey GROUP BY 1""",
    "preview_last3": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 3",
    "preview_last3_per_table": """
SELECT topic, off, op, row_key FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY off DESC, row_key DESC, op DESC) AS rn FROM multi_feed) WHERE rn <= 3""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "fk_orphans": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_gaps) GROUP BY l_orderkey",
    "fk_orphan_rows": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_gaps)",
    "fk_targets": """
SELECT f.fk_id, coalesce(a.target_table, CASE WHEN f.system = 'oracle' THEN coalesce(u.target_table, os.target_table, sx.target_table) ELSE ps.target_table END,
                         concat('shop_', f.referred_table)) AS target_table
FROM fks f LEFT JOIN fk_mapping a ON a.source_table = f.referred_table
LEFT JOIN fk_mapping u ON u.source_table = upper(f.referred_table)
LEFT JOIN fk_mapping os ON os.source_table = concat(upper(f.referred_schema), '.', upper(f.referred_table)) AND f.referred_schema IS NOT NULL
LEFT JOIN (SELECT upper(split_part(concat('.', source_table), '.', -1)) AS k, min(target_table) AS target_table FROM fk_mapping GROUP BY 1) sx
  ON sx.k = upper(f.referred_table)
LEFT JOIN fk_mapping ps ON ps.source_table = concat(f.referred_schema, '.', f.referred_table) AND f.referred_schema IS NOT NULL""",
    "constraint_preview": """
SELECT w.*, CASE WHEN w.tbl NOT IN (SELECT tbl FROM existing_tables) THEN 'table_not_ready'
                 WHEN EXISTS (SELECT 1 FROM existing_constraints e WHERE e.tbl = w.tbl AND e.constraint_name = w.constraint_name) THEN 'already_exists'
                 WHEN w.referred_tbl IS NOT NULL AND w.referred_tbl NOT IN (SELECT tbl FROM existing_tables) THEN 'cannot_create'
                 ELSE 'will_create' END AS status
FROM wanted_constraints w""",
    "copied_indexes": """
SELECT tbl, name, concat('idx_', tbl, '_', split_part(column_list, ',', 1)) AS new_name, concat('fk_', tbl, '_', split_part(column_list, ',', 1)) AS fk_name, is_unique
FROM index_catalog WHERE name <> 'PRIMARY' AND column_list NOT IN ('a,b', 'b,a')""",
    "unassigned_tables": """
SELECT l.tbl FROM listing l JOIN emptiness e ON l.tbl = e.tbl
WHERE coalesce(NOT e.is_empty, true)
  AND l.tbl NOT IN (SELECT source_table FROM assigned WHERE is_enabled)
  AND l.tbl NOT IN (SELECT concat(source_schema, '.', source_table) FROM assigned WHERE is_enabled AND source_schema IS NOT NULL)""",
    "column_types": f"""
WITH canon AS (SELECT * FROM (VALUES {CANONICAL_ROWS}) AS v(system, base, canonical)),
trans AS (SELECT * FROM (VALUES {TRANSLATION_ROWS}) AS v(system, target, base, result)),
sizes AS (SELECT * FROM (VALUES {SIZED_ROWS}) AS v(system, target, sized)),
maxes AS (SELECT * FROM (VALUES {MAX_ROWS}) AS v(system, target, name, unbounded)),
sparks AS (SELECT * FROM (VALUES {SPARK_ROWS}) AS v(canonical, spark_name)),
p AS (SELECT col_id, system, type_name, trim(regexp_replace(lower(type_name), '\\([^)]*\\)', '')) AS base,
             coalesce(length, TRY_CAST(regexp_extract(type_name, '\\((\\d+)', 1) AS INT)) AS len,
             coalesce(scale, TRY_CAST(regexp_extract(type_name, '\\(\\d+,(\\d+)', 1) AS INT)) AS sc FROM type_catalog),
c AS (SELECT p.*, CASE WHEN coalesce(k.canonical, 'String') = 'String' AND coalesce(p.len, 0) <= 0 THEN 'Text' ELSE coalesce(k.canonical, 'String') END AS canonical
      FROM p LEFT JOIN canon k ON p.system = k.system AND p.base = k.base)
SELECT p.col_id, p.system, p.canonical,
       CASE WHEN p.canonical = 'Numeric' AND p.len > 0 THEN concat('decimal(', p.len, ',', coalesce(p.sc, 0), ')') ELSE s.spark_name END AS spark_type,
       {_translated('postgresql', 'NUMERIC')}, {_translated('mysql', 'DECIMAL')}
FROM c p JOIN sparks s ON p.canonical = s.canonical""",
    "lossy_casts": """
SELECT s.type_name AS old_type, t.type_name AS new_type,
       (s.type_name IN ('VARCHAR', 'TEXT')) <> (t.type_name IN ('VARCHAR', 'TEXT')) AND (s.type_name NOT IN ('TIMESTAMP', 'DATETIME') AND t.type_name NOT IN ('TIMESTAMP', 'DATETIME')) AS is_lossy,
       count(*) AS n
FROM source_columns s JOIN target_columns t ON s.tbl = t.tbl AND s.name = t.name GROUP BY 1, 2, 3""",
    "schema_differences": f"""
WITH {SIMILAR},
e AS (SELECT x.* FROM explicit_renames x WHERE EXISTS (SELECT 1 FROM target_columns t WHERE t.tbl = x.tbl AND t.name = x.old_name)),
os AS (SELECT s.*, g.grp FROM source_columns s LEFT JOIN similar_types g ON s.type_name = g.name
       WHERE NOT EXISTS (SELECT 1 FROM target_columns t WHERE t.tbl = s.tbl AND t.name = s.name)
         AND NOT EXISTS (SELECT 1 FROM e WHERE e.tbl = s.tbl AND e.new_name = s.name)),
ot AS (SELECT t.*, g.grp FROM target_columns t LEFT JOIN similar_types g ON t.type_name = g.name
       WHERE NOT EXISTS (SELECT 1 FROM source_columns s WHERE t.tbl = s.tbl AND t.name = s.name)
         AND NOT EXISTS (SELECT 1 FROM e WHERE e.tbl = t.tbl AND e.old_name = t.name)),
m AS (SELECT os.tbl, ot.name AS old_name, os.name AS new_name FROM os JOIN ot ON os.tbl = ot.tbl AND os.pos = ot.pos
      AND coalesce(os.grp, os.type_name) = coalesce(ot.grp, ot.type_name))
SELECT tbl, 1 AS stage, 'RENAME_COLUMN' AS operation, old_name AS column_name, new_name, false AS is_destructive FROM e
UNION ALL SELECT tbl, 3, 'RENAME_COLUMN', old_name, new_name, false FROM m
UNION ALL SELECT tbl, 4, 'ADD_COLUMN', name, NULL, false FROM os WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tbl = os.tbl AND m.new_name = os.name)
UNION ALL SELECT tbl, 5, 'DROP_COLUMN', name, NULL, true FROM ot WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tbl = ot.tbl AND m.old_name = ot.name)""",
    "schema_differences_typed": """
WITH j AS (SELECT coalesce(s.tbl, t.tbl) AS tbl, coalesce(s.name, t.name) AS name, s.name AS sn, t.name AS tn, s.type_name AS st, t.type_name AS tt,
                  s.length AS sl, t.length AS tl
           FROM source_columns s FULL JOIN target_columns t ON s.tbl = t.tbl AND s.name = t.name),
a AS MATERIALIZED (SELECT DISTINCT tbl AS a_tbl FROM source_columns), b AS MATERIALIZED (SELECT DISTINCT tbl AS b_tbl FROM target_columns),
k AS (SELECT j.*, a_tbl, b_tbl FROM j LEFT JOIN a ON j.tbl = a_tbl LEFT JOIN b ON j.tbl = b_tbl),
o AS (SELECT *, CASE WHEN a_tbl IS NULL THEN NULL WHEN b_tbl IS NULL THEN 'CREATE_TABLE'
                     WHEN tn IS NULL THEN 'ADD_COLUMN' WHEN sn IS NULL THEN 'DROP_COLUMN'
                     WHEN (st = 'INT' AND tt = 'INTEGER') OR (st = 'VARCHAR' AND tt = 'TEXT' AND coalesce(sl, 0) <= 0)
                       OR (st = tt AND (st NOT IN ('VARCHAR', 'DECIMAL', 'NUMERIC') OR sl IS NOT DISTINCT FROM tl))
                       OR (st = 'DECIMAL' AND tt = 'NUMERIC' AND sl IS NOT DISTINCT FROM tl) THEN NULL
                     ELSE 'MODIFY_COLUMN' END AS operation FROM k)
SELECT tbl, operation, name AS column_name, st AS type_name, CASE WHEN operation = 'MODIFY_COLUMN' THEN tt END AS old_type,
       operation = 'DROP_COLUMN' AS is_destructive FROM o WHERE operation IS NOT NULL""",
    "tables_without_keys": """
SELECT tbl, count(*) AS columns FROM source_columns GROUP BY tbl HAVING NOT bool_or(pos = 0 AND type_name <> 'INT')""",
    "statement_routes": f"""
WITH e AS (SELECT * FROM (VALUES {_rows(list(EXPECTED_ROUTES.items()))}) AS v(kind, route))
SELECT d.system, e.route, count(*) AS n FROM ddl_text d JOIN e ON d.ddl_id % 16 = e.kind GROUP BY d.system, e.route""",
    "alter_clauses": f"""WITH {CLAUSES}
SELECT d.ddl_id, e.clause_no, e.operation, e.column_name, e.new_name, e.type_name, coalesce(e.length, -1) AS length, coalesce(e.scale, -1) AS scale,
       CAST(e.is_optional AS VARCHAR) AS is_optional, e.default_value, e.index_name, e.index_columns, CAST(e.is_unique AS VARCHAR) AS is_unique, e.is_destructive
FROM ddl_text d JOIN expected e ON d.ddl_id % 16 = e.kind""",
    "ddl_operations": f"WITH {GATED} SELECT ddl_id, clause_no, tbl, operation, status FROM gated",
    "ddl_counts": f"WITH {GATED} SELECT operation, status, count(*) AS n FROM gated GROUP BY operation, status",
    "column_renames": "SELECT ddl_id, tbl, 'x' AS old_name, 'y' AS new_name FROM ddl_text WHERE ddl_id % 16 IN (4, 5)",
    "table_renames": """
WITH p AS (SELECT ddl_id, 0 AS clause_no, concat('tab', ddl_id) AS old_table, concat('new', ddl_id) AS new_table FROM rename_text
           UNION ALL SELECT ddl_id, 1, concat('tab', ddl_id + 1), concat('tab', ddl_id + 2) FROM rename_text)
SELECT ddl_id, clause_no, old_table, new_table,
       CASE WHEN old_table NOT IN (SELECT tbl FROM ddl_targets) THEN 'old_missing' WHEN new_table IN (SELECT tbl FROM ddl_targets) THEN 'new_exists' ELSE 'apply' END AS status
FROM p""",
    "evolved_state": f"""
WITH {folded()},
a AS (SELECT max(off) AS add_off FROM ddl_between WHERE operation = 'ADD_COLUMN')
SELECT topic, user_id, off, CASE WHEN topic LIKE '%users_3' THEN NULL ELSE event_type END AS event_type,
       CASE WHEN topic LIKE '%users_2' THEN NULL ELSE value END AS value, CASE WHEN topic LIKE '%users_2' THEN value END AS amount,
       CASE WHEN topic LIKE '%users_2' THEN CASE WHEN off < (SELECT add_off FROM a) THEN 'web' ELSE 'app' END END AS origin
FROM w WHERE op <> 'd'""",
    "modify_losses": """
SELECT 'o_totalprice' AS column_name, count(*) FILTER (o_totalprice = 'n/a') AS lost_values FROM orders_text
UNION ALL SELECT 'o_custkey', 0 FROM orders_text GROUP BY 1
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NOT NULL) FROM orders_text""",
    "events_per_op_window": "SELECT date_trunc('hour', ts) AS window_start, topic, op, count(*) AS n FROM feed GROUP BY 1, 2, 3",
    "event_counts": """
SELECT topic, CASE op WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' WHEN 'd' THEN 'delete' WHEN 't' THEN 'truncate' END AS operation, count(*) AS n
FROM multi_feed GROUP BY 1, 2""",
    "latency_histogram": " UNION ALL ".join(
        [f"SELECT topic, '{le}' AS le, count(*) FILTER (delay_us <= {us}) AS n FROM applied GROUP BY topic" for le, us in LE]
        + ["SELECT topic, '+Inf' AS le, count(*) AS n FROM applied GROUP BY topic"]
    ),
    "consumer_lag": """
SELECT w.topic, w.part, w.position AS high, coalesce(c.committed, -1) AS committed, greatest(w.position - greatest(coalesce(c.committed, 0), 0), 0) AS lag
FROM watch_positions w LEFT JOIN sink_committed c ON w.topic = c.topic AND w.part = c.part""",
    "seconds_behind": """
WITH l AS (SELECT f.topic, max(ts) AS newest, max(CASE WHEN f.off < c.committed THEN ts END) AS done
           FROM feed f LEFT JOIN sink_committed c ON f.topic = c.topic AND f.part = c.part GROUP BY f.topic),
s AS (SELECT topic, CAST(floor((epoch_us(newest) - epoch_us(done)) / 1000000) AS BIGINT) AS lag_seconds FROM l)
SELECT topic, coalesce(lag_seconds, -1) AS lag_seconds, coalesce(lag_seconds > 60, true) AS is_late FROM s""",
    "incidents": f"""
WITH h AS (SELECT *, {HEALTH} AS health FROM health_samples),
k AS (SELECT pipeline, check_id, ts, 'source_failed' AS event_type, CASE WHEN health = 'healthy' THEN 0 WHEN source_state = 'FAILED' OR source_task_failed THEN 1 END AS signal FROM h
      UNION ALL SELECT pipeline, check_id, ts, 'connector_missing', CASE WHEN health = 'healthy' THEN 0 WHEN source_state = 'NOT_FOUND' AND NOT source_task_failed THEN 1 END FROM h
      UNION ALL SELECT pipeline, check_id, ts, 'sink_failed', CASE WHEN health = 'healthy' THEN 0 WHEN sink_state = 'FAILED' OR sink_task_failed THEN 1 END FROM h),
b AS (SELECT *, lag(signal) OVER (PARTITION BY pipeline, event_type ORDER BY ts, check_id) AS prev FROM k WHERE signal IS NOT NULL),
t AS (SELECT *, lead(ts) OVER (PARTITION BY pipeline, event_type ORDER BY ts, check_id) AS resolved_at FROM b WHERE coalesce(prev, 0) <> signal)
SELECT pipeline, event_type, check_id AS opened_by, ts AS opened_at, resolved_at FROM t WHERE signal = 1""",
    "health_rollup": f"""
WITH h AS (SELECT pipeline, {HEALTH} AS health FROM health_samples)
SELECT pipeline, count(*) AS total, count(*) FILTER (health = 'healthy') AS healthy, count(*) FILTER (health = 'degraded') AS degraded,
       count(*) FILTER (health = 'unhealthy') AS unhealthy FROM h GROUP BY pipeline""",
    "latest_samples": """
SELECT pipeline, check_id, source_state, sink_state,
       CASE source_state WHEN 'ERROR' THEN 0 WHEN 'FAILED' THEN 1 WHEN 'PAUSED' THEN 2 WHEN 'RUNNING' THEN 3 ELSE 4 END AS severity
FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY check_id DESC) AS rn FROM health_samples) WHERE rn = 1""",
    "state_counts": """
SELECT count(*) AS total, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'PAUSED') AS paused,
       count(*) FILTER (state = 'FAILED') AS failed FROM statuses""",
    "status_enrichment": """
SELECT c.pipeline, coalesce(s.state, 'NOT_FOUND') AS source_state, CASE WHEN c.sink_name IS NULL THEN 'NOT_CONFIGURED' ELSE coalesce(k.state, 'NOT_FOUND') END AS sink_state,
       coalesce(s.state IN ('RUNNING', 'PAUSED') AND NOT s.task_failed, false) AS is_healthy, t.target_db
FROM configs c LEFT JOIN statuses s ON c.source_name = s.name LEFT JOIN statuses k ON c.sink_name = k.name LEFT JOIN target_dbs t ON c.client = t.client""",
    "connection_health": """
WITH c AS (SELECT n.n_nationkey AS connection, count(s.name) AS total, count(*) FILTER (s.state = 'RUNNING') AS running, count(*) FILTER (s.state = 'FAILED') AS failed
           FROM nation n LEFT JOIN (SELECT c.client, s.name, s.state FROM configs c JOIN statuses s ON c.source_name = s.name) s ON s.client = n.n_nationkey
           GROUP BY n.n_nationkey)
SELECT connection, total, running, failed, CASE WHEN total = 0 THEN 'no_connectors' WHEN failed > 0 THEN 'degraded' WHEN running = total THEN 'healthy' ELSE 'partial' END AS health FROM c""",
    "sink_badges": """
SELECT c.client, CASE WHEN bool_or(s.state = 'FAILED') THEN 'FAILED' WHEN bool_or(s.state = 'PAUSED') THEN 'PAUSED'
                      WHEN bool_and(coalesce(s.state, 'NOT_CREATED') = 'RUNNING') THEN 'RUNNING' ELSE 'UNKNOWN' END AS badge
FROM configs c LEFT JOIN statuses s ON c.sink_name = s.name WHERE c.sink_name IS NOT NULL GROUP BY c.client""",
    "dead_letter_counts": "SELECT topic, CAST(sum(greatest(0, high - low)) AS BIGINT) AS n FROM dlq_offsets GROUP BY topic",
}
_LIVE = FOLDED.format(feed="good", keys="f.topic, f.user_id")
SQL["stream_truncate_aware_state"] = SQL["stream_recovered_state"] = SQL["truncate_aware_state"]
SQL["stream_handover_state"] = SQL["handover_state"]
SQL["stream_ddl_evolved_state"] = SQL["stream_ddl_epochs_state"] = SQL["stream_evolved_state"] = SQL["evolved_by_lineage"] = SQL["evolved_state"]
SQL["applied_operations"] = """
SELECT off, operation, column_name,
       CASE off % 10 WHEN 4 THEN 'absent' WHEN 3 THEN CASE WHEN (off // 10) % 3 = 2 THEN 'exists' ELSE 'success' END ELSE 'success' END AS outcome,
       off % 10 <> 4 AS is_column
FROM orders_operations"""
SQL["stream_multi_table_state"] = f"""
WITH good AS (SELECT * FROM damaged_feed WHERE damage IS NULL AND topic NOT LIKE '%users_1'),
{_LIVE}
SELECT CASE WHEN topic LIKE '%users_3' THEN 'people' ELSE concat('shop_', split_part(topic, '.', 3)) END AS target_table, user_id, event_type, value, off
FROM w WHERE op <> 'd'"""
SQL["stream_dead_letters"] = "SELECT topic, off, damage AS error_class FROM damaged_feed WHERE damage IS NOT NULL AND topic NOT LIKE '%users_1'"
_DOTTED = "SELECT '{0}' AS system, concat(source_schema, '.', source_table) AS name FROM mapping WHERE is_enabled"
SQL["included_names"] = " UNION ALL ".join([
    "SELECT 'mysql' AS system, concat('shop.', source_table) AS name FROM mapping WHERE is_enabled",
    *[_DOTTED.format(system) for system in ("postgresql", "mssql", "oracle")],
    "SELECT * FROM (VALUES ('postgresql', 'ddl_capture.ddl_events'), ('mssql', 'dbo.debezium_signal'), ('oracle', 'APP.DEBEZIUM_SIGNAL')) AS v(system, name)",
])
SQL["tables_with_rows"] = " UNION ALL ".join(f"SELECT '{name}' AS tbl WHERE EXISTS (SELECT 1 FROM {name})" for name in TABLES)
SQL["created_target"] = "SELECT * FROM orders"
SQL["refreshed_target"] = "SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"
SQL["wrapped_key_changes"] = "SELECT topic, off, op, user_id FROM feed WHERE op <> 't'"
SQL["index_operations"] = """
SELECT ddl_id, CASE WHEN ddl_id % 4 < 2 THEN 'ADD_INDEX' ELSE 'DROP_INDEX' END AS operation, tbl, concat('i', ddl_id) AS index_name,
       CASE ddl_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c' END AS index_columns, CASE ddl_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS is_unique
FROM index_text WHERE ddl_id % 4 < 3"""
SQL["default_literals"] = """
SELECT col_id, CASE WHEN value IS NULL OR auto_increment THEN NULL WHEN kind = 'string' THEN chr(39) || value || chr(39)
                    WHEN kind = 'boolean' THEN CASE WHEN lower(value) = 'true' THEN '1' ELSE '0' END ELSE value END AS default_text,
       is_key OR NOT optional AS not_null FROM column_defaults"""
SQL["stream_registry_hold"] = SQL["truncate_aware_state"]
SQL["stream_incidents"] = SQL["incidents"]
SQL["stream_paused_truncates"] = """
WITH t AS (SELECT topic, max(off) AS off FROM feed WHERE op = 't' GROUP BY topic)
SELECT topic, off, CASE WHEN topic LIKE '%users_1' THEN 'failed' ELSE 'applied' END AS outcome FROM t
UNION ALL SELECT topic, off, 'failed' FROM t WHERE topic LIKE '%users_1'"""
SQL["stream_resumed_state"] = f"""
WITH {folded()} SELECT topic, user_id, event_type, value, off FROM w WHERE op <> 'd' AND topic NOT LIKE '%users_0'
UNION ALL SELECT topic, user_id, event_type, value, position FROM users_now WHERE topic LIKE '%users_0'"""
SQL["stream_table_lifecycle"] = f"""
WITH {folded()} SELECT topic, user_id, event_type, value, off FROM w WHERE op <> 'd' AND topic NOT LIKE '%users_1' AND topic NOT LIKE '%users_2'
UNION ALL SELECT topic, user_id, event_type, value, position FROM users_now WHERE topic LIKE '%users_2'"""
_BARRIERS = """
WITH v AS (SELECT topic, part, max(pos) AS pos, max(off) + 1 AS next FROM {feed} GROUP BY topic, part),
b AS (SELECT topic, CASE WHEN count(*) >= 6 THEN min(pos) END AS reached FROM v GROUP BY topic),
t AS (SELECT f.topic, f.part, f.off, f.pos, coalesce(f.pos <= b.reached, false) AS released FROM {feed} f JOIN b ON f.topic = b.topic WHERE f.op = 't'),
last AS (SELECT topic, max(pos) AS pos FROM t WHERE released GROUP BY topic),
r AS (SELECT *, row_number() OVER (PARTITION BY topic, user_id ORDER BY pos DESC) AS n FROM {feed} WHERE op <> 't'),
w AS (SELECT r.topic, r.part, r.user_id, r.event_type, r.value, r.off, r.pos FROM r LEFT JOIN last ON r.topic = last.topic
      WHERE r.n = 1 AND r.op <> 'd' AND (last.pos IS NULL OR r.pos > last.pos))"""
SQL["partitioned_state"] = SQL["stream_partitioned_state"] = _BARRIERS.format(feed="partitioned_feed") + " SELECT * FROM w"
SQL["stream_lagging_partition_state"] = _BARRIERS.format(feed="lagging_feed") + " SELECT * FROM w"
_REACHED = "CASE WHEN count(*) >= 6 THEN min(pos) END"
SQL["stream_heartbeat_state"] = _BARRIERS.format(feed="lagging_feed").replace(_REACHED, "(SELECT max(pos) FROM lagging_feed)") + " SELECT * FROM w"
SQL["pending_truncates"] = SQL["stream_pending_truncates"] = (
    _BARRIERS.format(feed="lagging_feed") + " SELECT topic, part, off, pos FROM t WHERE NOT released"
)
SQL["stream_commit_positions"] = _BARRIERS.format(feed="lagging_feed") + """
SELECT v.topic, v.part, least(v.next, coalesce(p.first, v.next)) AS commit_position
FROM v LEFT JOIN (SELECT topic, part, min(off) AS first FROM t WHERE NOT released GROUP BY topic, part) AS p ON v.topic = p.topic AND v.part = p.part"""
SQL["stream_events_per_op_window"] = """
SELECT date_trunc('hour', ts) AS window_start, topic, op, count(*) AS n FROM feed
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM feed) - INTERVAL 10 MINUTE GROUP BY 1, 2, 3"""
SQL["stream_once_per_event"] = "SELECT event_id, event_type FROM events"
SQL["metadata_differences"] = f"""
WITH {SIMILAR},
os AS (SELECT s.*, g.grp FROM source_columns s LEFT JOIN similar_types g ON s.type_name = g.name
       WHERE NOT EXISTS (SELECT 1 FROM target_columns t WHERE t.tbl = s.tbl AND t.name = s.name)),
ot AS (SELECT t.*, g.grp FROM target_columns t LEFT JOIN similar_types g ON t.type_name = g.name
       WHERE NOT EXISTS (SELECT 1 FROM source_columns s WHERE t.tbl = s.tbl AND t.name = s.name)),
m AS (SELECT os.tbl, ot.name AS old_name, os.name AS new_name FROM os JOIN ot ON os.tbl = ot.tbl AND os.pos = ot.pos
      AND coalesce(os.grp, os.type_name) = coalesce(ot.grp, ot.type_name)),
d AS (SELECT tbl, 'RENAME_COLUMN' AS operation FROM m
      UNION ALL SELECT tbl, 'ADD_COLUMN' FROM os WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tbl = os.tbl AND m.new_name = os.name)
      UNION ALL SELECT tbl, 'DROP_COLUMN' FROM ot WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tbl = ot.tbl AND m.old_name = ot.name))
SELECT tbl, operation, count(*) AS n FROM d GROUP BY tbl, operation"""
SQL["constraint_summary"] = f"""
WITH p AS ({SQL['constraint_preview']})
SELECT pipeline, count(*) FILTER (status = 'will_create') AS will_create, count(*) FILTER (status = 'already_exists') AS already_exists,
       count(*) FILTER (status = 'cannot_create') AS cannot_create, count(*) FILTER (status = 'table_not_ready') AS table_not_ready
FROM p GROUP BY pipeline"""


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in SQL.items()}
