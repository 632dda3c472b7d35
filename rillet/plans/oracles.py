"""Oracle SQL (DuckDB dialect) for the registered queries, over the driver tables.

Offsets are the log's numbering written as window functions: dense per
(topic, partition) in the order the library assigns them.
"""

from __future__ import annotations

T1 = """t1 AS (
  SELECT 'topic1' AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS "offset",
         CAST(user_id AS VARCHAR) AS key, props AS value, ts
  FROM events)"""

BY_TYPE = """bt AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
         CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS "offset",
         CAST(user_id AS VARCHAR) AS key, props AS value, ts
  FROM events)"""

BY_ROLE = """bc AS (
  SELECT role AS topic, CAST(conv_id % 4 AS INTEGER) AS partition,
         CAST(row_number() OVER (PARTITION BY role, conv_id % 4 ORDER BY conv_id, turn) - 1 AS BIGINT) AS "offset",
         CAST(conv_id AS VARCHAR) AS key, text AS value
  FROM conversations)"""

ROUTED = f"""{T1},
r AS (SELECT *, CAST(json_extract_string(value, '$.k') AS INTEGER) AS k FROM t1),
routed AS (
  SELECT 'topic2' AS topic, partition, "offset" AS src_offset, value FROM r
  WHERE coalesce(k >= 80, false) OR NOT coalesce(k < 10, false)
  UNION ALL
  SELECT 'topic3' AS topic, partition, "offset" AS src_offset, value FROM r
  WHERE coalesce(k >= 80, false)),
numbered AS (
  SELECT topic, partition,
         CAST(row_number() OVER (PARTITION BY topic, partition ORDER BY src_offset) - 1 AS BIGINT) AS "offset",
         CAST(NULL AS VARCHAR) AS key, value, src_offset
  FROM routed)"""

LAG = f"""{T1},
lag AS (
  SELECT 'group1' AS group_id, topic, partition,
         CAST(max("offset") + 1 AS BIGINT) AS end_offset,
         CAST(coalesce(max("offset") FILTER (WHERE ts < TIMESTAMP '2024-01-15 00:00:00') + 1, 0) AS BIGINT) AS next_offset
  FROM t1 GROUP BY topic, partition)"""

GROUPED = """nx AS (
  SELECT a.partition, a."offset",
         LEAST(a."offset" + 20, coalesce(min(b."offset"), a."offset" + 20)) AS nxt
  FROM t1 a LEFT JOIN t1 b
    ON b.partition = a.partition AND b."offset" > a."offset" AND b."offset" < a."offset" + 20
   AND b.ts >= a.ts + INTERVAL 5 HOUR
  GROUP BY a.partition, a."offset"),
ends AS (SELECT partition, max("offset") + 1 AS end_offset FROM t1 GROUP BY partition),
walk(partition, first_offset) AS (
  SELECT partition, CAST(0 AS BIGINT) FROM ends
  UNION ALL
  SELECT w.partition, nx.nxt FROM walk w
  JOIN nx ON nx.partition = w.partition AND nx."offset" = w.first_offset
  JOIN ends e ON e.partition = w.partition
  WHERE nx.nxt < e.end_offset),
g AS (
  SELECT w.partition, w.first_offset,
         coalesce(lead(w.first_offset) OVER (PARTITION BY w.partition ORDER BY w.first_offset), e.end_offset) AS next_offset
  FROM walk w JOIN ends e ON e.partition = w.partition)"""

ORACLES: dict[str, str] = {
    "topic_from_events": f"""WITH {T1}
SELECT topic, partition, "offset", key, value FROM t1""",
    "produce_report": """WITH n AS (
  SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS "offset" FROM events)
SELECT 'numbers' AS topic, CAST(0 AS INTEGER) AS partition, "offset", CAST(event_id AS VARCHAR) AS value,
       CAST(event_id AS INTEGER) AS pass_through,
       'numbers/0 ' || CAST("offset" AS VARCHAR) || ': ' || CAST(event_id AS VARCHAR) AS report
FROM n""",
    "plain_sink_events": """SELECT 'topic1' AS topic, CAST(0 AS INTEGER) AS partition,
       CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS "offset",
       CAST(NULL AS VARCHAR) AS key, props AS value
FROM events""",
    "replicate_drop_key": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "replicate_keep_key": f"""WITH {BY_TYPE}
SELECT 'targetTopic' AS topic, bt.partition,
       CAST(row_number() OVER (PARTITION BY bt.partition ORDER BY bt.topic, bt."offset") - 1 AS BIGINT) AS "offset",
       bt.key, bt.value, bt.topic AS src_topic, bt."offset" AS src_offset
FROM bt""",
    "seek_offset": f"""WITH {T1}
SELECT topic, partition, "offset", key, value FROM t1 WHERE partition = 0 AND "offset" >= 1000""",
    "assign_partitions": f"""WITH {T1}
SELECT topic, partition, "offset", key, value FROM t1 WHERE partition IN (1, 2)""",
    "topic_catalog": f"""WITH {BY_TYPE}
SELECT topic, partition, CAST(min("offset") AS BIGINT) AS begin_offset,
       CAST(max("offset") + 1 AS BIGINT) AS end_offset, CAST(count(*) AS BIGINT) AS n_records
FROM bt GROUP BY topic, partition""",
    "fanout_two_topics": f"""WITH {T1}
SELECT 'topic2' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1
UNION ALL
SELECT 'topic3' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "route_conditional": f"""WITH {ROUTED}
SELECT topic, partition, "offset", key, value, src_offset FROM numbered""",
    "route_commits": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST(max("offset") + 1 AS BIGINT) AS next_offset
FROM t1 GROUP BY topic, partition""",
    "multi_result_report": f"""WITH {ROUTED}
SELECT partition AS src_partition, src_offset,
       string_agg(topic || '/' || CAST(partition AS VARCHAR) || ' ' || CAST("offset" AS VARCHAR) || ': ' || value, ', '
                  ORDER BY topic) AS report
FROM numbered GROUP BY partition, src_offset
UNION ALL
SELECT partition AS src_partition, "offset" AS src_offset, 'passed through' AS report
FROM r WHERE NOT coalesce(k >= 80, false) AND coalesce(k < 10, false)""",
    "commit_batches_20": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST("offset" // 20 AS BIGINT) AS batch,
       CAST(min("offset") AS BIGINT) AS first_offset, CAST(max("offset") + 1 AS BIGINT) AS next_offset,
       CAST(count(*) AS BIGINT) AS n_records
FROM t1 GROUP BY topic, partition, "offset" // 20""",
    "commit_batches_100": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST("offset" // 100 AS BIGINT) AS batch,
       CAST(min("offset") AS BIGINT) AS first_offset, CAST(max("offset") + 1 AS BIGINT) AS next_offset,
       CAST(count(*) AS BIGINT) AS n_records
FROM t1 GROUP BY topic, partition, "offset" // 100""",
    "grouped_within": f"""WITH RECURSIVE {T1},
{GROUPED}
SELECT 'topic1' AS topic, partition, CAST(first_offset AS BIGINT) AS first_offset,
       CAST(next_offset AS BIGINT) AS next_offset, CAST(next_offset - first_offset AS BIGINT) AS n_records
FROM g""",
    "consumer_lag": f"""WITH {LAG}
SELECT group_id, topic, partition, end_offset, next_offset,
       CAST(greatest(end_offset - next_offset, 0) AS BIGINT) AS lag
FROM lag""",
    "pending_gauge": f"""WITH {LAG}
SELECT CAST(sum(end_offset - next_offset) AS BIGINT) AS messages,
       '# HELP messages Number of messages in the queueService' || chr(10) || '# TYPE messages gauge' || chr(10)
       || 'messages ' || CAST(CAST(sum(end_offset - next_offset) AS BIGINT) AS VARCHAR) AS text
FROM lag""",
    "producer_metrics": f"""WITH {BY_TYPE}
SELECT topic, partition, CAST(count(*) AS BIGINT) AS n_records, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes
FROM bt GROUP BY topic, partition""",
    "consumer_metrics": f"""WITH {T1}
SELECT topic, partition, CAST(count(*) AS BIGINT) AS n_records, CAST(max("offset") AS BIGINT) AS max_offset,
       CAST(sum(strlen(value)) AS BIGINT) AS n_bytes
FROM t1 GROUP BY topic, partition""",
    "conversation_copy": f"""WITH {BY_ROLE}
SELECT 'dialogue' AS topic, bc.partition,
       CAST(row_number() OVER (PARTITION BY bc.partition ORDER BY bc.topic, bc."offset") - 1 AS BIGINT) AS "offset",
       bc.key, bc.value, bc.topic AS src_topic, bc."offset" AS src_offset
FROM bc""",
    "chain_hops": f"""WITH {T1}
SELECT 'hopC' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value,
       'hopB' AS src_topic, "offset" AS src_offset FROM t1""",
    "stream_exactly_once": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "stream_fanout": f"""WITH {T1}
SELECT 'topic2' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1
UNION ALL
SELECT 'topic3' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "external_offsets": f"""WITH {T1}
SELECT 'processed' AS topic, partition, "offset", key, value, "offset" AS src_offset FROM t1""",
    "external_offsets_inclusive": f"""WITH {T1},
first_run AS (
  SELECT partition, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 00:00:00') AS k FROM t1 GROUP BY partition)
SELECT 'processed' AS topic, partition, "offset", key, value, "offset" AS src_offset
FROM t1 WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
UNION ALL
SELECT 'processed' AS topic, t1.partition,
       CAST(CASE WHEN f.k = 0 THEN t1."offset" ELSE t1."offset" + 1 END AS BIGINT) AS "offset",
       t1.key, t1.value, t1."offset" AS src_offset
FROM t1 JOIN first_run f ON f.partition = t1.partition
WHERE t1."offset" >= greatest(f.k - 1, 0)""",
    "csv_to_json_topic": """SELECT 'csv_events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset",
       CAST(user_id AS VARCHAR) AS key,
       to_json(struct_pack(event_id := event_id, ts := strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), user_id := user_id, event_type := event_type,
                           value := value, props := props)) AS value
FROM events""",
    "csv_multiline_documents": """SELECT doc_id, lang, source, CAST(n_chars AS BIGINT) AS n_chars, md5(text) AS text_md5,
       CAST(length(text) AS BIGINT) AS text_chars FROM documents""",
    "replicate_batched_commits": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST(max("offset") + 1 AS BIGINT) AS next_offset
FROM t1 GROUP BY topic, partition, "offset" // 20""",
    "replicate_grouped_commits": f"""WITH RECURSIVE {T1},
{GROUPED}
SELECT 'group1' AS group_id, 'topic1' AS topic, partition, CAST(next_offset AS BIGINT) AS next_offset FROM g""",
    "chain_exactly_once": f"""WITH {T1}
SELECT 'hopC' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value,
       'hopB' AS src_topic, "offset" AS src_offset FROM t1""",
    "business_results": f"""WITH {T1}
SELECT topic, partition, "offset", key || '=' || value AS result FROM t1""",
    "per_record_commits": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST("offset" + 1 AS BIGINT) AS next_offset FROM t1""",
    "stream_grouped_commits": f"""WITH RECURSIVE {T1},
{GROUPED}
SELECT 'group1' AS group_id, 'topic1' AS topic, partition, CAST(next_offset AS BIGINT) AS next_offset FROM g""",
    "topic_catalog_compacted": f"""WITH {T1}
SELECT topic, partition, CAST(min("offset") AS BIGINT) AS begin_offset, CAST(max("offset") + 1 AS BIGINT) AS end_offset,
       CAST(count(*) AS BIGINT) AS n_records
FROM t1 GROUP BY topic, partition""",
    "stream_groups_keyed": f"""WITH RECURSIVE {T1},
{GROUPED}
SELECT 'topic1' AS topic, g.partition, CAST(first_offset AS BIGINT) AS first_offset,
       CAST(next_offset AS BIGINT) AS next_offset, CAST(next_offset - first_offset AS BIGINT) AS n_records
FROM g JOIN ends e ON e.partition = g.partition
WHERE next_offset < e.end_offset OR next_offset - first_offset = 20""",
    "stream_file_sink": f"""WITH {T1}
SELECT topic, partition, "offset", key, value FROM t1""",
    "stream_batched_commits": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST(max("offset") + 1 AS BIGINT) AS next_offset
FROM t1 GROUP BY topic, partition, "offset" // 20""",
    "stream_route": f"""WITH {ROUTED}
SELECT topic, partition, "offset", key, value, src_offset FROM numbered""",
    "stream_two_sources": f"""WITH {BY_TYPE}
SELECT 'targetTopic' AS topic, partition, key, value, topic AS src_topic, "offset" AS src_offset
FROM bt""",
    "replicate_two_logs": f"""WITH {T1},
early AS (
  SELECT partition, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 00:00:00') AS k FROM t1 GROUP BY partition)
SELECT 'test1' AS topic, t1.partition, t1."offset", CAST(NULL AS VARCHAR) AS key, t1.value,
       CAST(CASE WHEN t1."offset" < e.k THEN t1."offset" ELSE t1."offset" - e.k END AS BIGINT) AS src_offset
FROM t1 JOIN early e ON e.partition = t1.partition""",
    "replicate_completed": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "fanout_resume": f"""WITH {T1}
SELECT 'topic2' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1
UNION ALL
SELECT 'topic3' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "route_resume": f"""WITH {ROUTED}
SELECT topic, partition, "offset", key, value, src_offset FROM numbered""",
    "partition_running_sums": f"""WITH {T1}
SELECT 'sums' AS topic, partition, "offset", key,
       CAST(CAST(sum(coalesce(CAST(json_extract_string(value, '$.k') AS INTEGER), 0))
         OVER (PARTITION BY partition ORDER BY "offset") AS BIGINT) AS VARCHAR) AS value, "offset" AS src_offset
FROM t1""",
    "partition_commits_100": f"""WITH {T1}
SELECT 'group1' AS group_id, topic, partition, CAST(max("offset") + 1 AS BIGINT) AS next_offset
FROM t1 GROUP BY topic, partition, "offset" // 100""",
    "range_source": """WITH n AS (SELECT row_number() OVER () AS number FROM events)
SELECT 'numbers' AS topic, CAST(0 AS INTEGER) AS partition, CAST(number - 1 AS BIGINT) AS "offset",
       CAST(number AS VARCHAR) AS value, CAST(number AS INTEGER) AS pass_through,
       'numbers/0 ' || CAST(number - 1 AS VARCHAR) || ': ' || CAST(number AS VARCHAR) AS report
FROM n""",
    "single_envelopes": f"""WITH {T1}
SELECT 'single' AS topic, partition, "offset", key, value, "offset" AS src_offset FROM t1""",
    "replicate_resume": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "replicate_hook": f"""WITH {T1},
h AS (
  SELECT partition, "offset" AS src_offset, value,
         unnest(range(0, CASE WHEN "offset" % 10 = 5 THEN 0 WHEN "offset" % 7 = 3 THEN 2 ELSE 1 END)) AS c
  FROM t1)
SELECT 'test1' AS topic, partition,
       CAST(row_number() OVER (PARTITION BY partition ORDER BY src_offset, c) - 1 AS BIGINT) AS "offset",
       CAST(NULL AS VARCHAR) AS key, value, src_offset
FROM h""",
    "seek_stored_positions": f"""WITH {T1},
stored AS (
  SELECT partition, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 00:00:00') AS k FROM t1 GROUP BY partition)
SELECT t1.topic, t1.partition, t1."offset", t1.key, t1.value
FROM t1 JOIN stored s ON s.partition = t1.partition WHERE t1."offset" >= s.k""",
    "assign_all_partitions": f"""WITH {T1}
SELECT topic, partition, "offset", key, value FROM t1""",
    "stream_at_most_once": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
    "stream_at_least_once": f"""WITH {T1}
SELECT 'test1' AS topic, partition, "offset", CAST(NULL AS VARCHAR) AS key, value, "offset" AS src_offset FROM t1""",
}
