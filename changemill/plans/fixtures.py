"""Change feeds, catalogs and samples derived from the given tables.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its oracle start
from the same rows. Every view covers its whole tables; conditions on a remainder plant damage,
gaps, renames and states in known places. ``with_views`` stacks the views an oracle needs into a WITH clause;
``view`` builds the same view as a DataFrame. Arithmetic is integer only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _type_texts() -> list[str]:
    """Every known type name of every system, plain and with parameters, and unknown ones."""
    from changemill.functions.types import CANONICAL_NAMES

    texts = [(s, n) for s, names in CANONICAL_NAMES.items() for n in names]
    texts += [(s, n.upper() + "(12,3)") for s, names in CANONICAL_NAMES.items() for n, c in names.items() if c in ("Numeric", "String")]
    texts += [("postgresql", "timestamp(6) with time zone"), ("mysql", "geometry"), ("mssql", "hierarchyid"), ("mysql", "DECIMAL(10,0)")]
    return [f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(texts)]


_TYPE_TEXTS = len(_type_texts())
_TYPE_ROWS = ", ".join(_type_texts())


VIEWS: dict[str, str] = {
    # Change feed of shop.users_0 to shop.users_3 keyed by user_id; tables 0 and 1 get truncated.
    "feed": """
        SELECT concat('client_1_db_2_v_1.shop.users_', CAST(user_id % 4 AS VARCHAR(2))) AS topic,
               0 AS part, event_id AS off,
               CASE WHEN event_id % 100 = 49 AND user_id % 4 < 2 THEN 't'
                    WHEN event_type = 'signup' THEN 'c'
                    WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op,
               ts, user_id, event_type, value, props
        FROM events""",
    # The same changes dealt by key over six partitions, each with its own offsets; the source position is left
    # to compare them. In the lagging feed the last partition has been read to the middle only.
    "partitioned_feed": """
        SELECT topic, CAST(floor(user_id / 4) % 6 AS INT) AS part,
               row_number() OVER (PARTITION BY topic, floor(user_id / 4) % 6 ORDER BY off) - 1 AS off,
               off AS pos, op, user_id, event_type, value
        FROM feed""",
    "lagging_feed": """
        SELECT * FROM partitioned_feed WHERE part < 5 OR 2 * pos <= (SELECT max(pos) FROM partitioned_feed)""",
    # The users tables as their source holds them when the whole feed has been written.
    "users_now": """
        SELECT topic, user_id, event_type, value, (SELECT max(off) FROM feed) AS position
        FROM (SELECT *, row_number() OVER (PARTITION BY topic, user_id ORDER BY off DESC) AS n FROM feed) AS f WHERE n = 1""",
    "orders_feed": """
        SELECT concat('client_1_db_2_v_1.shop.', CASE WHEN o_orderkey IS NULL THEN 'none' ELSE 'orders' END) AS topic,
               0 AS part, o_orderkey AS off,
               CASE WHEN o_orderkey % 11 = 0 THEN 'd' ELSE 'u' END AS op,
               o_orderkey AS row_key, CAST(o_orderstatus AS VARCHAR(20)) AS label
        FROM orders""",
    "customer_feed": """
        SELECT concat('client_1_db_3_v_2.sales.dbo.', CASE WHEN c_custkey IS NULL THEN 'none' ELSE 'customer' END) AS topic,
               0 AS part, c_custkey AS off,
               'c' AS op, c_custkey AS row_key, CAST(c_mktsegment AS VARCHAR(20)) AS label
        FROM customer""",
    # Topics that no sink subscribes to: the DDL capture table and the signal table.
    "internal_feed": """
        SELECT CASE WHEN event_id % 2 = 0 THEN 'client_1_db_2_v_1.ddl_capture.ddl_events'
                    ELSE 'client_1_db_2_v_1.shop.debezium_signal' END AS topic,
               0 AS part, event_id AS off, 'c' AS op, event_id AS row_key,
               CAST(event_type AS VARCHAR(20)) AS label
        FROM events WHERE event_type = 'view'""",
    "multi_feed": """
        SELECT topic, part, off, op, user_id AS row_key, CAST(event_type AS VARCHAR(20)) AS label
        FROM feed
        UNION ALL SELECT topic, part, off, op, row_key, label FROM orders_feed
        UNION ALL SELECT topic, part, off, op, row_key, label FROM customer_feed
        UNION ALL SELECT topic, part, off, op, row_key, label FROM internal_feed""",
    # One mapping row per captured table, from the tables that the feed itself names.
    "mapping": """
        SELECT CASE WHEN topic LIKE 'client_1_db_3%' THEN 3 ELSE 2 END AS db_id,
               CASE WHEN topic LIKE '%dbo.customer' THEN 'dbo' ELSE 'shop' END AS source_schema,
               regexp_replace(topic, '^.*[.]', '') AS source_table,
               CASE WHEN topic LIKE '%.orders' THEN 'all_orders'
                    WHEN topic LIKE '%dbo.customer' THEN 'sales_customer'
                    ELSE concat('shop_', regexp_replace(topic, '^.*[.]', '')) END AS target_table,
               topic NOT LIKE '%dbo.customer' AS is_enabled
        FROM (SELECT DISTINCT topic FROM multi_feed
              WHERE topic NOT LIKE '%ddl_events' AND topic NOT LIKE '%debezium_signal') AS t""",
    "customer_changes": """
        SELECT o_custkey AS c_custkey, o_orderkey AS off,
               CASE WHEN o_orderkey % 13 = 0 THEN 'd' ELSE 'u' END AS op,
               concat('Customer#', CAST(o_custkey AS VARCHAR(20))) AS c_name,
               CAST(o_orderkey % 25 AS INT) AS c_nationkey,
               o_totalprice AS c_acctbal, CAST(o_orderpriority AS VARCHAR(20)) AS c_mktsegment
        FROM orders""",
    "orders_copy": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 97 <> 0
        UNION ALL
        SELECT o_orderkey + 10000000000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 103 = 0""",
    "orders_text": """
        SELECT o_orderkey AS off, CAST(o_orderkey AS VARCHAR(20)) AS o_orderkey,
               CAST(o_custkey AS VARCHAR(20)) AS o_custkey,
               o_orderstatus,
               CASE WHEN o_orderkey % 211 = 0 THEN 'n/a'
                    ELSE CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR(30)) END AS o_totalprice,
               CASE WHEN o_orderkey % 223 = 0 THEN '0000-00-00 00:00:00'
                    WHEN o_orderkey % 227 = 0 THEN '1996-13-45 00:00:00'
                    ELSE CAST(o_orderdate AS VARCHAR(30)) END AS o_orderdate
        FROM orders""",
    # Inserts into customer: about half of the keys exist already, and keys repeat.
    "customer_inserts": """
        SELECT o_custkey + (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM customer) AS c_custkey,
               o_orderkey AS off, CASE WHEN o_orderkey % 13 = 0 THEN 'd' ELSE 'u' END AS op,
               concat('Customer#', CAST(o_custkey AS VARCHAR(20))) AS c_name,
               CAST(o_orderkey % 25 AS INT) AS c_nationkey, o_totalprice AS c_acctbal,
               CAST(o_orderpriority AS VARCHAR(20)) AS c_mktsegment
        FROM orders""",
    "orders_gaps": "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0",
    "truncates_pending": "SELECT topic, part, off FROM feed WHERE op = 't'",
    "sink_committed": """
        SELECT topic, part, CAST(floor(max(off) / 2) AS BIGINT) AS committed FROM feed
        WHERE topic NOT LIKE '%users_3' GROUP BY topic, part""",
    "watch_positions": "SELECT topic, part, max(off) + 1 AS position FROM feed GROUP BY topic, part",
    # Log of changes to the orders table that runs while its chunks are read.
    "orders_log": """
        SELECT event_id AS off, event_id * 10 + event_id % 50 AS o_orderkey,
               CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op,
               value AS o_totalprice
        FROM events""",
    # One health check per event: both connectors of pipeline user_id % 10.
    "health_samples": """
        SELECT concat('pipeline_', CAST(user_id % 10 AS VARCHAR(2))) AS pipeline, event_id AS check_id, ts,
               CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view' THEN 'PAUSED'
                    WHEN event_id % 37 = 0 THEN 'NOT_FOUND' ELSE 'RUNNING' END AS source_state,
               event_id % 29 = 0 AS source_task_failed,
               CASE WHEN event_id % 11 = 0 THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'PAUSED'
                    WHEN event_id % 41 = 0 THEN 'NOT_CONFIGURED' ELSE 'RUNNING' END AS sink_state,
               event_id % 31 = 0 AS sink_task_failed
        FROM events""",
    "applied": """
        SELECT topic, part, off, op, ts, CAST(value * 100 AS BIGINT) * 10000 AS delay_us FROM feed""",
    # Column catalogs of one table per supplier: the source side and an aged target side.
    "source_columns": """
        SELECT concat('t', CAST(s.s_suppkey AS VARCHAR(20))) AS tbl,
               CASE WHEN p.p_partkey % 7 = 3 THEN concat('new_', CAST(p.p_partkey AS VARCHAR(20)))
                    ELSE concat('c', CAST(p.p_partkey AS VARCHAR(20))) END AS name,
               CAST(row_number() OVER (PARTITION BY s.s_suppkey ORDER BY p.p_partkey) - 1 AS INT) AS pos,
               CASE p.p_size % 5 WHEN 0 THEN 'INT' WHEN 1 THEN 'VARCHAR' WHEN 2 THEN 'DECIMAL'
                                 WHEN 3 THEN 'DATETIME' ELSE 'BIGINT' END AS type_name,
               CASE p.p_size % 5 WHEN 1 THEN 50 WHEN 2 THEN 10 END AS length,
               CASE p.p_size % 5 WHEN 2 THEN 2 END AS scale
        FROM supplier s JOIN part p ON p.p_partkey % (SELECT count(*) FROM supplier) = s.s_suppkey
        WHERE p.p_partkey % 11 <> 5""",
    "target_columns": """
        SELECT concat('t', CAST(s.s_suppkey AS VARCHAR(20))) AS tbl,
               concat('c', CAST(p.p_partkey AS VARCHAR(20))) AS name,
               CAST(row_number() OVER (PARTITION BY s.s_suppkey ORDER BY p.p_partkey) - 1 AS INT) AS pos,
               CASE p.p_size % 5 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'NUMERIC'
                    WHEN 3 THEN 'TIMESTAMP'
                    ELSE CASE WHEN p.p_partkey % 3 = 0 THEN 'INTEGER' ELSE 'BIGINT' END END AS type_name,
               CASE p.p_size % 5 WHEN 2 THEN CASE WHEN p.p_partkey % 2 = 0 THEN 10 ELSE 12 END END AS length,
               CASE p.p_size % 5 WHEN 2 THEN 2 END AS scale
        FROM supplier s JOIN part p ON p.p_partkey % (SELECT count(*) FROM supplier) = s.s_suppkey
        WHERE p.p_partkey % 13 <> 6 AND s.s_suppkey % 10 <> 9""",
    "explicit_renames": """
        SELECT tbl, concat('c', substr(name, 5)) AS old_name, name AS new_name
        FROM source_columns WHERE name LIKE 'new_%' AND pos % 2 = 0""",
    # One chunk completion per event: tables t<user> read by pipeline user_id % 10.
    "chunk_completions": """
        SELECT concat('pipeline_', CAST(user_id % 10 AS VARCHAR(2))) AS pipeline,
               CASE WHEN user_id % 10 IN (3, 6) OR event_id % 5 = 0 THEN 'initial' ELSE 'incremental' END AS kind,
               concat('t', CAST(user_id AS VARCHAR(20))) AS tbl,
               1024 - event_id % 24 AS rows, ts AS started_at, ts AS finished_at,
               event_type = 'purchase' AND event_id % 7 = 0 AS is_last
        FROM events WHERE user_id % 10 <> 8""",
    "snapshot_tables": """
        SELECT DISTINCT concat('pipeline_', CAST(user_id % 10 AS VARCHAR(2))) AS pipeline,
               concat('t', CAST(user_id AS VARCHAR(20))) AS tbl
        FROM events""",
    "streaming_pipelines": """
        SELECT DISTINCT concat('pipeline_', CAST(user_id % 10 AS VARCHAR(2))) AS pipeline
        FROM events WHERE user_id % 2 = 0""",
    # Counts per table on both sides: table orders_<n> of pipeline n % 10.
    "sync_source": """
        SELECT concat('orders_', CAST(o_custkey % 50 AS VARCHAR(4))) AS tbl, count(*) AS n,
               CAST(NULL AS VARCHAR(20)) AS error
        FROM orders GROUP BY o_custkey % 50""",
    "sync_target": """
        SELECT concat('copy_', CAST(o_custkey % 50 AS VARCHAR(4))) AS tbl, count(*) AS n,
               CAST(NULL AS VARCHAR(20)) AS error
        FROM orders_copy WHERE o_custkey % 10 NOT IN (4, 5, 7) AND o_custkey % 50 <> 11 GROUP BY o_custkey % 50
        UNION ALL
        SELECT concat('copy_', CAST(o_custkey % 50 AS VARCHAR(4))) AS tbl, count(*) AS n,
               CAST(NULL AS VARCHAR(20)) AS error
        FROM orders WHERE o_custkey % 10 IN (4, 5) GROUP BY o_custkey % 50
        UNION ALL
        SELECT DISTINCT concat('copy_', CAST(o_custkey % 50 AS VARCHAR(4))) AS tbl, CAST(NULL AS BIGINT) AS n,
               CAST('db_unreachable' AS VARCHAR(20)) AS error
        FROM orders WHERE o_custkey % 10 = 7""",
    "sync_mapping": """
        SELECT DISTINCT concat('pipeline_', CAST(o_custkey % 10 AS VARCHAR(2))) AS pipeline,
               concat('orders_', CAST(o_custkey % 50 AS VARCHAR(4))) AS source_table,
               concat('copy_', CAST(o_custkey % 50 AS VARCHAR(4))) AS target_table,
               o_custkey % 50 <> 12 AS is_enabled
        FROM orders""",
    "sync_pipelines": """
        SELECT concat('pipeline_', CAST(o_custkey % 10 AS VARCHAR(2))) AS pipeline,
               CASE WHEN o_custkey % 10 IN (2, 5) THEN max(o_orderdate) ELSE min(o_orderdate) END AS created_at,
               max(o_orderdate) AS checked_at,
               o_custkey % 10 IN (1, 2) AS snapshot_running, min(o_orderdate) AS last_success_at
        FROM orders GROUP BY o_custkey % 10
        UNION ALL
        SELECT 'pipeline_without_tables' AS pipeline, min(o_orderdate) AS created_at, max(o_orderdate) AS checked_at,
               false AS snapshot_running, min(o_orderdate) AS last_success_at
        FROM orders""",
    # Foreign keys of four source systems and the mapping they are resolved against.
    "fk_mapping": """
        SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('TAB_', CAST(s_suppkey AS VARCHAR(20)))
                    WHEN 1 THEN concat('APP.TAB_', CAST(s_suppkey AS VARCHAR(20)))
                    ELSE concat('tab_', CAST(s_suppkey AS VARCHAR(20))) END AS source_table,
               concat('tgt_', CAST(s_suppkey AS VARCHAR(20))) AS target_table
        FROM supplier""",
    "fks": """
        SELECT p_partkey AS fk_id,
               CASE p_partkey % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' WHEN 2 THEN 'mssql' ELSE 'oracle' END AS system,
               'shop' AS db,
               concat(CASE WHEN p_size % 2 = 0 THEN 'tab_' ELSE 'TAB_' END,
                      CAST(p_partkey % (SELECT count(*) + 10 FROM supplier) AS VARCHAR(20))) AS referred_table,
               CASE p_size % 3 WHEN 0 THEN 'APP' WHEN 1 THEN 'app' END AS referred_schema
        FROM part""",
    # Constraints wanted on one target table per part, against what exists already.
    "wanted_constraints": """
        SELECT concat('pipeline_', CAST(p_size % 10 AS VARCHAR(2))) AS pipeline,
               concat('tgt_', CAST(p_partkey % 500 AS VARCHAR(20))) AS tbl,
               CASE WHEN p_partkey % 2 = 0 THEN concat('fk_tgt_', CAST(p_partkey % 500 AS VARCHAR(20)), '_c', CAST(p_partkey AS VARCHAR(20)))
                    ELSE concat('idx_tgt_', CAST(p_partkey % 500 AS VARCHAR(20)), '_c', CAST(p_partkey AS VARCHAR(20))) END AS constraint_name,
               CASE WHEN p_partkey % 2 = 0 THEN concat('tgt_', CAST(p_partkey % 700 AS VARCHAR(20))) END AS referred_tbl
        FROM part""",
    "existing_constraints": """
        SELECT tbl, constraint_name FROM wanted_constraints WHERE constraint_name LIKE '%3'
        UNION ALL SELECT tbl, constraint_name FROM wanted_constraints WHERE constraint_name LIKE '%8'""",
    "existing_tables": """
        SELECT DISTINCT concat('tgt_', CAST(p_partkey % 500 AS VARCHAR(20))) AS tbl FROM part WHERE p_partkey % 500 % 9 <> 4""",
    # Index catalog: one index per part over one or two columns of a table with a two-column key.
    "index_catalog": """
        SELECT concat('tgt_', CAST(p_partkey % 500 AS VARCHAR(20))) AS tbl,
               CASE WHEN p_partkey % 17 = 0 THEN 'PRIMARY' ELSE concat('i', CAST(p_partkey AS VARCHAR(20))) END AS name,
               CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b,a' WHEN 2 THEN 'a,b' ELSE 'c' END AS column_list,
               'a,b' AS key_list, p_size % 2 = 0 AS is_unique
        FROM part""",
    # Connectors of pipelines, their configs and clients, one config per customer.
    "configs": """
        SELECT concat('cfg_', CAST(c_custkey AS VARCHAR(20))) AS pipeline, c_nationkey AS client,
               concat('src_', CAST(c_custkey AS VARCHAR(20))) AS source_name,
               CASE WHEN c_custkey % 6 <> 0 THEN concat('snk_', CAST(c_custkey AS VARCHAR(20))) END AS sink_name
        FROM customer""",
    "statuses": """
        SELECT concat('src_', CAST(c_custkey AS VARCHAR(20))) AS name,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'PAUSED' WHEN 'MACHINERY' THEN 'FAILED' ELSE 'RUNNING' END AS state,
               c_custkey % 9 = 2 AS task_failed
        FROM customer WHERE c_custkey % 8 <> 1
        UNION ALL
        SELECT concat('snk_', CAST(c_custkey AS VARCHAR(20))) AS name,
               CASE WHEN c_nationkey % 5 = 0 THEN 'RUNNING' WHEN c_custkey % 7 = 3 THEN 'FAILED'
                    WHEN c_nationkey % 2 = 1 AND c_custkey % 5 = 1 THEN 'PAUSED' ELSE 'RUNNING' END AS state,
               false AS task_failed
        FROM customer WHERE c_custkey % 10 <> 7""",
    "target_dbs": """
        SELECT n_nationkey AS client, concat('db_', CAST(n_name AS VARCHAR(20))) AS target_db
        FROM nation WHERE n_nationkey % 4 <> 3""",
    "dlq_offsets": """
        SELECT topic, CAST(user_id % 3 AS INT) AS part, min(off) AS low, max(off) - CAST(900 AS BIGINT) AS high
        FROM feed GROUP BY topic, CAST(user_id % 3 AS INT)""",
    # Tables a source lists, bare or with schema, and which of them are known to be empty.
    "listing": """
        SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat('APP.T', CAST(s_suppkey AS VARCHAR(20)))
                    ELSE concat('t', CAST(s_suppkey AS VARCHAR(20))) END AS tbl
        FROM supplier""",
    "assigned": """
        SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'APP' END AS source_schema,
               CASE WHEN s_suppkey % 2 = 0 THEN concat('T', CAST(s_suppkey AS VARCHAR(20)))
                    ELSE concat('t', CAST(s_suppkey AS VARCHAR(20))) END AS source_table,
               s_suppkey % 7 <> 0 AS is_enabled
        FROM supplier WHERE s_suppkey % 5 < 3""",
    "emptiness": """
        SELECT tbl, CASE WHEN length(tbl) % 2 = 0 THEN tbl LIKE '%7' END AS is_empty FROM listing""",
    # DDL statements, sixteen kinds, one statement per part.
    "ddl_text": """
        SELECT p_partkey AS ddl_id,
               CASE WHEN p_partkey % 16 IN (11, 12, 13) THEN 'postgresql' ELSE 'mysql' END AS system,
               concat('tab', CAST(p_partkey % 100 AS VARCHAR(20))) AS tbl,
               concat(CASE p_partkey % 16
                   WHEN 0 THEN 'ALTER TABLE tab ADD COLUMN a INT, DROP COLUMN b, MODIFY c DECIMAL(10,2)'
                   WHEN 1 THEN 'alter table `shop`.`tab` MODIFY c INT NOT NULL'
                   WHEN 2 THEN 'ALTER TABLE tab ADD PRIMARY KEY (a, b)'
                   WHEN 3 THEN 'ALTER TABLE tab ADD UNIQUE INDEX i (a, b), ADD KEY j (c)'
                   WHEN 4 THEN 'ALTER TABLE tab CHANGE COLUMN x y VARCHAR(20) NOT NULL'
                   WHEN 5 THEN 'ALTER TABLE tab RENAME COLUMN x TO y'
                   WHEN 6 THEN 'CREATE TABLE tab (a INT)'
                   WHEN 7 THEN 'DROP TABLE tab'
                   WHEN 8 THEN 'TRUNCATE TABLE tab'
                   WHEN 9 THEN 'ALTER TABLE tab CHANGE z z BIGINT, ADD CONSTRAINT k UNIQUE (a), DROP PRIMARY KEY'
                   WHEN 10 THEN 'ALTER TABLE tab ADD d DATETIME NOT NULL DEFAULT ''now'', DROP INDEX i'
                   WHEN 11 THEN 'ALTER TABLE public.tab ALTER COLUMN c SET DATA TYPE TEXT'
                   WHEN 12 THEN 'ALTER TABLE "tab" ALTER COLUMN c SET NOT NULL, ADD COLUMN IF NOT EXISTS e character varying(30)'
                   WHEN 13 THEN 'ALTER TABLE tab DROP COLUMN IF EXISTS f, ADD g INT'
                   WHEN 14 THEN 'ALTER TABLE tab ADD CHECK ((a > 0))'
                   ELSE 'GRANT ALL ON tab TO someone' END,
                   CASE WHEN p_size % 2 = 0 THEN ';' ELSE '' END) AS ddl
        FROM part""",
    "ddl_targets": """
        SELECT DISTINCT concat('tab', CAST(p_partkey % 100 AS VARCHAR(20))) AS tbl FROM part WHERE p_partkey % 100 % 10 <> 4""",
    "rename_text": """
        SELECT s_suppkey AS ddl_id,
               concat('RENAME TABLE tab', CAST(s_suppkey AS VARCHAR(20)), ' TO `shop`.`new', CAST(s_suppkey AS VARCHAR(20)),
                      '`, shop.tab', CAST(s_suppkey + 1 AS VARCHAR(20)), ' TO tab', CAST(s_suppkey + 2 AS VARCHAR(20))) AS ddl
        FROM supplier""",
    # DDL capture rows: two copies of each event, some processed, some of system schemas.
    "capture_rows": """
        SELECT event_id * 2 AS off, concat('e', CAST(event_id AS VARCHAR(20))) AS event_id,
               CASE WHEN event_id % 13 = 0 THEN 'pg_catalog' ELSE 'public' END AS schema_name,
               event_type = 'error' AS processed,
               concat('public.users_', CAST(user_id % 4 AS VARCHAR(2)), CASE WHEN event_type = 'view' THEN '.col' ELSE '' END) AS object_name,
               CASE WHEN event_type = 'view' THEN 'table column' ELSE 'table' END AS object_type
        FROM events
        UNION ALL
        SELECT event_id * 2 + 1 AS off, concat('e', CAST(event_id AS VARCHAR(20))) AS event_id,
               CASE WHEN event_id % 13 = 0 THEN 'pg_catalog' ELSE 'public' END AS schema_name,
               event_type = 'error' AS processed, 'public.other' AS object_name, 'table' AS object_type
        FROM events WHERE event_id % 3 = 0""",
    # DDL between the changes of users_2 and users_3, at fractions of the feed.
    "ddl_between": """
        SELECT CAST('client_1_db_2_v_1.shop.users_2' AS VARCHAR(60)) AS tbl, max(off) - CAST(floor(max(off) / 50) AS BIGINT) AS off,
               'RENAME_COLUMN' AS operation, 'value' AS column_name, 'amount' AS new_name,
               CAST(NULL AS VARCHAR(20)) AS type_name, CAST(NULL AS VARCHAR(20)) AS default_value
        FROM feed
        UNION ALL
        SELECT 'client_1_db_2_v_1.shop.users_2' AS tbl, max(off) - CAST(floor(max(off) / 80) AS BIGINT) AS off,
               'ADD_COLUMN' AS operation, 'origin' AS column_name, CAST(NULL AS VARCHAR(20)) AS new_name,
               'string' AS type_name, 'web' AS default_value
        FROM feed
        UNION ALL
        SELECT 'client_1_db_2_v_1.shop.users_3' AS tbl, max(off) - CAST(floor(max(off) / 60) AS BIGINT) AS off,
               'DROP_COLUMN' AS operation, 'event_type' AS column_name, CAST(NULL AS VARCHAR(20)) AS new_name,
               CAST(NULL AS VARCHAR(20)) AS type_name, CAST(NULL AS VARCHAR(20)) AS default_value
        FROM feed""",
    # Statements on indexes, and one on something else.
    "index_text": """
        SELECT p_partkey AS ddl_id, 'postgresql' AS system, concat('t', CAST(p_partkey AS VARCHAR(19))) AS tbl,
               CASE p_partkey % 4
                    WHEN 0 THEN concat('CREATE UNIQUE INDEX IF NOT EXISTS i', CAST(p_partkey AS VARCHAR(19)), ' ON t', CAST(p_partkey AS VARCHAR(19)), ' (a, b)')
                    WHEN 1 THEN concat('create index i', CAST(p_partkey AS VARCHAR(19)), ' on t', CAST(p_partkey AS VARCHAR(19)), ' (c)')
                    WHEN 2 THEN concat('DROP INDEX IF EXISTS i', CAST(p_partkey AS VARCHAR(19)))
                    ELSE 'ALTER TABLE t ADD x INT' END AS ddl
        FROM part""",
    "column_defaults": """
        SELECT p_partkey AS col_id, CASE p_partkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' ELSE 'number' END AS kind,
               CASE WHEN p_partkey % 5 = 4 THEN NULL
                    WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE 'false' END
                    ELSE CAST(p_size AS VARCHAR(9)) END AS value,
               p_partkey % 7 = 0 AS auto_increment, p_partkey % 11 = 0 AS is_key, p_partkey % 2 = 0 AS optional
        FROM part""",
    # Four operations a nation: a column is added, then dropped, renamed or widened, then added again, and one that
    # never was is dropped.
    "orders_operations": """
        SELECT n_nationkey * 10 + s.step AS off,
               CASE s.step WHEN 1 THEN 'ADD_COLUMN' WHEN 3 THEN 'ADD_COLUMN' WHEN 4 THEN 'DROP_COLUMN'
                    ELSE CASE n_nationkey % 3 WHEN 0 THEN 'DROP_COLUMN' WHEN 1 THEN 'RENAME_COLUMN' ELSE 'MODIFY_COLUMN' END END AS operation,
               concat(CASE WHEN s.step = 4 THEN 'x_' ELSE 'c_' END, CAST(n_nationkey AS VARCHAR(9))) AS column_name,
               CASE WHEN s.step = 2 AND n_nationkey % 3 = 1 THEN concat('r_', CAST(n_nationkey AS VARCHAR(9))) END AS new_name,
               CASE WHEN s.step IN (1, 3) THEN 'int' WHEN s.step = 2 AND n_nationkey % 3 = 2 THEN 'bigint' END AS type_name,
               CASE WHEN s.step = 1 THEN '7' END AS default_value
        FROM nation CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(step)""",
    # The same DDL as the statements that a capture table holds.
    "ddl_statements": """
        SELECT off AS ddl_id, off, 'mysql' AS system, tbl,
               CASE operation WHEN 'RENAME_COLUMN' THEN 'ALTER TABLE shop.users RENAME COLUMN value TO amount'
                    WHEN 'ADD_COLUMN' THEN 'ALTER TABLE shop.users ADD COLUMN origin VARCHAR(20) DEFAULT ''web'', ADD KEY i (origin)'
                    ELSE 'ALTER TABLE shop.users DROP COLUMN event_type' END AS ddl
        FROM ddl_between""",
    # The users feed as it is written around that DDL: new names and columns after it.
    "evolving_feed": """
        SELECT topic, user_id, op, off,
               CASE WHEN topic LIKE '%users_3' AND off >= (SELECT max(off) FROM ddl_between WHERE operation = 'DROP_COLUMN')
                    THEN NULL ELSE event_type END AS event_type,
               CASE WHEN topic LIKE '%users_2' AND off >= (SELECT max(off) FROM ddl_between WHERE operation = 'RENAME_COLUMN')
                    THEN NULL ELSE value END AS value,
               CASE WHEN topic LIKE '%users_2' AND off >= (SELECT max(off) FROM ddl_between WHERE operation = 'RENAME_COLUMN')
                    THEN value END AS amount,
               CASE WHEN topic LIKE '%users_2' AND off >= (SELECT max(off) FROM ddl_between WHERE operation = 'ADD_COLUMN')
                    THEN 'app' END AS origin
        FROM feed""",
    # Columns with type texts of every source system, one per part.
    "type_catalog": """
        SELECT p_partkey AS col_id, t.system AS system, t.type_name AS type_name,
               CASE WHEN p_size % 4 = 0 THEN CAST(p_size + 1 AS INT) WHEN p_size % 4 = 1 THEN -1 END AS length,
               CASE WHEN p_size % 8 = 0 THEN 2 END AS scale
        FROM part JOIN type_texts t ON p_partkey % """ + str(_TYPE_TEXTS) + """ = t.i""",
    "type_texts": "SELECT * FROM (VALUES " + _TYPE_ROWS + ") AS v(i, system, type_name)",
    # Envelopes with planted damage, by offset.
    "damaged_feed": """
        SELECT topic, part, off, op, user_id, event_type, value,
               CASE WHEN off % 19 = 0 THEN 'malformed_json' WHEN off % 23 = 0 THEN 'unknown_op'
                    WHEN off % 29 = 0 AND op IN ('c', 'u') THEN 'missing_after'
                    WHEN off % 31 = 0 AND op IN ('c', 'u') THEN 'missing_key' END AS damage
        FROM feed""",
    # Snapshot signals: one per order of every 40th customer, for one of five tables.
    "signal_rows": """
        SELECT o_orderkey AS off, concat('client_1_db_', CAST(o_custkey % 3 AS VARCHAR(4)), '_v_1') AS prefix,
               CASE o_orderkey % 5 WHEN 0 THEN 'pause-snapshot' WHEN 1 THEN 'resume-snapshot' WHEN 2 THEN 'stop-snapshot'
                                   ELSE 'execute-snapshot' END AS signal_type,
               concat('shop.', CASE o_custkey % 5 WHEN 0 THEN 'users_0' WHEN 1 THEN 'users_1' WHEN 2 THEN 'orders'
                                                  WHEN 3 THEN 'unknown' ELSE 'users_3' END) AS collection
        FROM orders""",
    # Schema-history messages: DDL text per part, some of system databases, some broken.
    "history_rows": """
        SELECT ddl_id AS off, ddl, CASE WHEN ddl_id % 10 = 7 THEN 'MySQL' ELSE 'shop' END AS db,
               ddl_id % 41 = 3 AS broken, ddl_id % 43 = 5 AS is_null
        FROM ddl_text""",
}


def _needed(name: str, seen: list[str]) -> list[str]:
    for other in VIEWS:
        if other != name and other not in seen and re.search(rf"\b{other}\b", VIEWS[name]):
            _needed(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Prefix an oracle text with the derived views it mentions."""
    needed: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            _needed(name, needed)
    if not needed:
        return sql
    stacked = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {stacked},\n{body[5:]}"
    return f"WITH {stacked}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of one scale-factor folder.

    Every view below it is a frame of its own, not a WITH clause: Spark numbers the clauses of a query through, so a
    cached frame with clauses is not found again behind another that has some, and its true size with it.
    """
    made: dict[str, DataFrame] = {}
    for needed in _needed(name, []):
        text, sources = VIEWS[needed], {}
        for source in (*made, *TABLES):
            found = re.compile(rf"\b(FROM|JOIN)\s+{source}\b")
            if found.search(text):
                sources[f"tbl_{source}"] = made[source] if source in made else table(spark, sf_dir, source)
                text = found.sub(rf"\1 {{tbl_{source}}}", text)
        made[needed] = spark.sql(text, **sources)
    return made[name]
