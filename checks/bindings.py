"""The given test tables, read as the library's source relations.

Each relation is one SELECT that Spark and DuckDB both understand, so the
queries and their independent SQL start from the same rows. ``@name@`` stands
for a test table. Styles change how request text and executed text differ:

* mixed: one third each single-line, multi-line with semicolon, marker comment
* commented: every text carries the marker comment (only a prefix can match)
* reworded: texts differ between characters 51 and 100 (only 50 can match)
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spendtrace.schemas import RATE_CARDS
from spendtrace.sources.tables import UsageTables

AS_OF = "2024-01-30"  # events and everything bound to them
AS_OF_ORDERS = "2001-07-15"  # metering
START, END = "2024-01-05 00:00:00", "2024-01-28 23:59:59.999999"
ORDERS_START, ORDERS_END = "1995-01-01 00:00:00", "2001-12-31 23:59:59.999999"

TABLES = ("events", "orders", "documents", "embeddings", "nation")

_CORE = """'SELECT c_' || k || ' FROM t_' || user_id || ' WHERE region = ''north'' AND status = ''active'' '
    || 'AND amount BETWEEN 10 AND 5000 AND created_at >= ''2023-01-01'''"""

_K = """(SELECT event_id, ts, user_id, event_type, value,
    CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS k FROM @events@)"""

# Every event with its k and the SQL text both sides of a match are made from.
_EVENTS = f"(SELECT *, {_CORE} AS core FROM {_K} e0)"

_COMMENTED = "core || chr(10) || ' -- Generated by Assistant' || chr(10) || ';'"

_REQUEST_TEXT = {
    "mixed": f"""CASE user_id % 3 WHEN 0 THEN core
        WHEN 1 THEN replace(core, ' WHERE ', chr(10) || 'WHERE ') || ';'
        ELSE {_COMMENTED} END""",
    "commented": _COMMENTED,
    "reworded": "core",
}
_EXECUTED_TEXT = {
    "mixed": f"""CASE user_id % 3
        WHEN 0 THEN replace(core, ' ', '  ') || CASE WHEN value > 20 THEN ' /* c */' ELSE '' END
        WHEN 1 THEN lower(core) ELSE {_COMMENTED} END""",
    "commented": _COMMENTED,
    "reworded": "replace(core, 'active', 'closed')",
}

_MODELS = [name for name, *_ in RATE_CARDS["SI"]]
_MODEL = (
    "CASE k % 8 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_MODELS))
    + " ELSE 'unlisted-model' END"
)


def _request_log_raw(style: str) -> str:
    return f"""
SELECT ts AS "timestamp", 'req-' || event_id AS request_id,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '@db.models/model_' || (k % 7) || '.yaml' END AS semantic_model_name,
  'db.t_' || user_id AS tables_referenced,
  CASE WHEN user_id % 50 = 0 THEN NULL ELSE 'user_' || user_id END AS user_name,
  'API' AS source, CASE WHEN value > 50 THEN 'positive' END AS feedback,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS response_status_code,
  '{{"messages":[{{"role":"user","content":[{{"type":"text","text":"question ' || (k % 20) || '"}}]}}]}}' AS request_body,
  '{{"response_metadata":{{"question_category":"category ' || (k % 4) || '"'
    || CASE WHEN event_type = 'error' THEN ''
       ELSE ',"analyst_latency_ms":' || CAST(round(value * 100) AS BIGINT) END
    || CASE k % 3 WHEN 0 THEN ',"analyst_orchestration_path":"vqr_fast_path"'
       WHEN 1 THEN ',"analyst_orchestration_path":"regular"' ELSE '' END
    || '}},"message":{{"content":[{{"type":"text"}},{{"type":"sql","confidence":{{'
    || CASE WHEN k % 3 = 0 AND k % 15 <> 0 THEN '"verified_query_used":{{"name":"vq_' || (k % 20)
       || '","question":"verified question ' || (k % 20) || '"}}' ELSE '' END
    || '}}}}]}}}}' AS response_body,
  CASE WHEN event_type = 'error' THEN NULL WHEN k = 99 THEN '' ELSE {_REQUEST_TEXT[style]} END AS generated_sql
FROM {_EVENTS} e"""


def _query_history(style: str) -> str:
    return f"""
SELECT 'q-' || event_id AS query_id, {_EXECUTED_TEXT[style]} AS query_text,
  CASE event_id % 3 WHEN 0 THEN 'ai-agent' WHEN 1 THEN '' END AS query_tag,
  ts AS start_time, ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) AS end_time,
  CAST(round(value * 10) AS BIGINT) AS total_elapsed_time,
  'WH_' || (user_id % 5) AS warehouse_name, 'size_' || (user_id % 3) AS warehouse_size,
  'svc_' || (user_id % 10) AS user_name, 'role_' || (k % 3) AS role_name,
  CASE WHEN k = 50 THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
  value / 1000 AS credits_used_cloud_services
FROM {_EVENTS} e WHERE event_type IN ('view', 'purchase')"""


_FIXED = {
    # Cheap queries are not attributed at all; a band above them has 0 credits.
    "query_attribution": f"""
SELECT 'q-' || event_id AS query_id,
  CASE WHEN value < 6 THEN 0.0e0 ELSE value / 10000 END AS credits_attributed_compute
FROM {_EVENTS} e WHERE event_type IN ('view', 'purchase') AND value >= 3""",
    "function_usage": f"""
SELECT ts AS start_time, CASE WHEN event_type IN ('view', 'click') THEN 'COMPLETE' ELSE upper(event_type) END
    AS function_name,
  {_MODEL} AS model_name, CAST(k * 100 AS BIGINT) AS tokens, value / 1000 AS token_credits,
  CAST(user_id % 5 AS BIGINT) AS warehouse_id, value / 1000 AS credits_used,
  CAST(k * 70 AS BIGINT) AS input_tokens, CAST(k * 30 AS BIGINT) AS output_tokens
FROM {_EVENTS} e""",
    "function_query_usage": f"""
SELECT 'q-' || event_id AS query_id, {_MODEL} AS model_name,
  CASE WHEN event_type = 'view' THEN 'COMPLETE' ELSE upper(event_type) END AS function_name,
  CAST(k * 100 AS BIGINT) AS tokens, value / 1000 AS token_credits
FROM {_EVENTS} e""",
    "warehouse_metering": """
SELECT CAST(n_nationkey % 6 AS BIGINT) AS warehouse_id, 'WH_' || (n_nationkey % 6) AS warehouse_name,
  CAST(n_nationkey AS DOUBLE) * 1.5e0 AS credits_used_compute FROM @nation@""",
    "metering": """
SELECT o_orderdate AS start_time,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'AI_SERVICES' ELSE 'WAREHOUSE' END AS service_type,
  o_totalprice / 1000 AS credits_used FROM @orders@""",
    "analyst_usage": f"""
SELECT ts AS start_time, value / 100 AS credits, value / 100 AS credits_attributed,
  CAST(1 + k % 3 AS BIGINT) AS request_count FROM {_EVENTS} e WHERE event_type = 'signup'""",
    "document_usage": """
SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(doc_id % 30 AS INT) AS start_time,
  n_chars / 10000.0e0 AS credits_used, CAST(1 + floor(n_chars / 3000.0e0) AS BIGINT) AS page_count,
  CAST(1 AS BIGINT) AS document_count FROM @documents@""",
    "search_usage": """
SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(vec_id % 30 AS INT) AS start_time,
  'svc_' || label AS service_name, vec_id / 1000.0e0 AS credits FROM @embeddings@""",
    "agents": """
SELECT n_name AS name, 'db_' || n_regionkey AS database_name, 'agents' AS schema_name,
  CASE WHEN n_nationkey = 0 THEN '{"tool_resources": {broken'
    WHEN n_nationkey = 1 THEN '{"models": {}}'
    WHEN n_nationkey = 2 THEN '{"tool_resources": {"search": {"name": "svc"}}}'
    WHEN n_nationkey % 3 = 0 THEN '{"tool_resources": {"sales": {"semantic_model_file": "@db.models/model_'
      || (2 + n_nationkey % 5) || '.yaml"}, "costs": {"semantic_model_file": "@db.models/model_'
      || (2 + (n_nationkey + 1) % 5) || '.yaml"}}}'
    ELSE '{"tool_resources": {"sales": {"semantic_model_file": "@db.models/model_'
      || (2 + n_nationkey % 5) || '.yaml"}}}' END AS agent_spec
FROM @nation@""",
    "agent_events_raw": f"""
SELECT ts AS "timestamp",
  '{{"user.name":"user_' || user_id || '","db.user":"db_user_' || user_id || '"}}' AS resource_attributes,
  '{{"ai.observability.object.name":"agent_' || (k % 6) || '"'
    || CASE WHEN event_type IN ('view', 'purchase')
       THEN ',"ai.observability.agent.tool.sql_execution.query_id":"q-' || event_id || '"' ELSE
       ',"ai.observability.agent.planning.model":"' || {_MODEL} || '"'
       || ',"ai.observability.agent.planning.token_count.input":' || (k * 1000)
       || ',"ai.observability.agent.planning.token_count.output":' || (k * 50)
       || ',"ai.observability.agent.planning.token_count.cache_creation":' || (k * 10)
       || CASE WHEN k % 4 = 0 THEN '' ELSE
          ',"ai.observability.agent.planning.token_count.cache_read":' || (k * 20) END
       || ',"ai.observability.agent.planning.token_count.total":' || (k * 1050) END
    || '}}' AS record_attributes,
  CASE WHEN event_type IN ('view', 'purchase') THEN '{{"name":"SqlExecution"}}' ELSE '{{"name":"Planning"}}' END AS record
FROM {_EVENTS} e""",
    "scheduled_runs": f"""
SELECT CASE WHEN k % 5 = 0 THEN 'CLEANUP_' ELSE 'AI_MONITOR_' END || (k % 4) AS name,
  CASE WHEN k % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, ts AS scheduled_time,
  ts + INTERVAL '1' SECOND * 2 AS query_start_time,
  ts + INTERVAL '1' SECOND * CAST(floor(2 + value) AS INT) AS completed_time,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 'ok' END AS return_value,
  CASE WHEN k % 7 = 0 THEN '100' END AS error_code, CASE WHEN k % 7 = 0 THEN 'timeout' END AS error_message
FROM {_EVENTS} e WHERE event_type = 'error'""",
}


def relation_sql(name: str, style: str = "mixed") -> str:
    if name == "request_log_raw":
        return _request_log_raw(style)
    if name == "query_history":
        return _query_history(style)
    return _FIXED[name]


def spark_relation(spark: SparkSession, sf_dir: str, name: str, style: str = "mixed") -> DataFrame:
    sql = relation_sql(name, style).replace('"timestamp"', "timestamp")
    for table in TABLES:
        if f"@{table}@" in sql:
            sql = sql.replace(f"@{table}@", _view(spark, sf_dir.rstrip("/"), table))
    return spark.sql(sql)


def _view(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Session view of one test table, so its schema is read once."""
    view = re.sub(r"\W", "_", f"{table}_at_{sf_dir}")
    if not spark.catalog.tableExists(view):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return view


def duckdb_relation(name: str, style: str = "mixed") -> str:
    sql = relation_sql(name, style).replace("TIMESTAMP_NTZ", "TIMESTAMP")
    for table in TABLES:
        sql = sql.replace(f"@{table}@", table)
    return sql


class BoundTables(UsageTables):
    """The test tables behind the library's own relation names."""

    def __init__(self, spark: SparkSession, sf_dir: str, style: str = "mixed"):
        super().__init__(spark)
        self.sf_dir, self.style = sf_dir, style

    def get(self, relation: str) -> DataFrame:
        return spark_relation(self.spark, self.sf_dir, relation, self.style)
