"""Independent SQL (DuckDB) for every query in :mod:`checks.queries`.

The SQL works row by row and pair by pair on the bound relations; it shares no
code with the library beyond the relations themselves.
"""

from __future__ import annotations

import re

from checks.bindings import AS_OF, END, ORDERS_END, ORDERS_START, START, duckdb_relation
from spendtrace.operators.budgets import EXAMPLE_RULES
from spendtrace.schemas import RATE_CARDS

ORACLE: dict[str, str] = {}

# --- small SQL builders -----------------------------------------------------


def credits(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,9))"


def csum(x: str) -> str:
    return f"SUM({credits(x)})"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def half_even(x: str, digits: int) -> str:
    scale = f"{10 ** digits}.0e0"
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}, 0) / {scale})"


def half_up(x: str, digits: int) -> str:
    return f"CAST(round({x}, {digits}) AS DOUBLE)"


def ratio_half_up(num: str, den: str, digits: int) -> str:
    """Exact half-up rounding of a quotient of non-negative whole numbers."""
    n, d = f"CAST({num} AS HUGEINT)", f"nullif(CAST({den} AS HUGEINT), 0)"
    return f"(CAST((2 * {10 ** digits} * {n} + {d}) // (2 * {d}) AS DOUBLE) / {10 ** digits}.0e0)"


def micro(x: str) -> str:
    """Credits as whole millionths; test credits have no finer digits."""
    return f"CAST(round({x} * 1000000.0e0) AS HUGEINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def window(column: str = "start_time", start: str = START, end: str = END) -> str:
    return f"{column} BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}'"


# --- shared relations -------------------------------------------------------


def _trimmed(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def _uncommented(x: str) -> str:
    lines = f"regexp_replace({x}, '--[^' || chr(10) || ']*' || chr(10), chr(10), 'g')"
    return f"regexp_replace({lines}, '/\\*.*?\\*/', ' ', 'g')"


def cleaned(x: str) -> str:
    return f"trim(regexp_replace({_uncommented(x)}, '\\s+', ' ', 'g'))"


def normalized(x: str) -> str:
    return f"rtrim(regexp_replace(upper({_trimmed(x)}), '\\s+', ' ', 'g'), ';')"


def normalized_latency(x: str) -> str:
    return f"rtrim(regexp_replace(upper({_uncommented(_trimmed(x))}), '\\s+', ' ', 'g'), ';')"


_BODY = "json_extract_string(response_body, '$.{}')"
_LATENCY = f"CAST(round(CAST({_BODY.format('response_metadata.analyst_latency_ms')} AS DOUBLE)) AS BIGINT)"
_QUESTION = "json_extract_string(request_body, '$.messages[0].content[0].text')"
_VERIFIED = "message.content[1].confidence.verified_query_used"


def _token(kind: str) -> str:
    key = f'$."ai.observability.agent.planning.token_count.{kind}"'
    return f"CAST(json_extract_string(record_attributes, '{key}') AS BIGINT)"


def _attribute(column: str, key: str) -> str:
    return f"json_extract_string({column}, '$.\"{key}\"')"


def _derived(style: str) -> dict[str, str]:
    """Named CTE bodies; a query pulls in the ones it mentions."""
    raw = {
        name: duckdb_relation(name, style)
        for name in (
            "request_log_raw",
            "query_history",
            "query_attribution",
            "metering",
            "function_usage",
            "function_query_usage",
            "analyst_usage",
            "document_usage",
            "search_usage",
            "warehouse_metering",
            "agents",
            "agent_events_raw",
            "scheduled_runs",
        )
    }
    path = _BODY.format("response_metadata.analyst_orchestration_path")
    return raw | {
        "req": f"""
SELECT "timestamp", request_id, semantic_model_name, tables_referenced, user_name, source, feedback,
  response_status_code, {_QUESTION} AS user_question, {_LATENCY} AS latency_ms, generated_sql,
  {path} AS orchestration_path, {_BODY.format('response_metadata.question_category')} AS question_category,
  {_BODY.format(_VERIFIED + '.name')} AS verified_query_name,
  {_BODY.format(_VERIFIED + '.question')} AS verified_query_question,
  CASE WHEN {path} = 'vqr_fast_path' THEN 'Verified Query' ELSE 'Non-Verified Query' END AS query_type,
  CAST(0.067 AS DOUBLE) AS request_credits
FROM request_log_raw""",
        "hist": f"""
SELECT qh.query_id, query_text, start_time, total_elapsed_time, warehouse_name, user_name,
  credits_attributed_compute, {cleaned('query_text')} AS cleaned_query_text
FROM query_history qh JOIN query_attribution qa ON qh.query_id = qa.query_id
WHERE query_tag = 'ai-agent' AND start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  AND credits_attributed_compute > 0""",
        "h_norm": f"SELECT *, {normalized('cleaned_query_text')} AS norm FROM hist",
        "r_norm": f"SELECT *, {normalized('generated_sql')} AS norm FROM req",
        "pairs": _pairs((None, 100, 50)),
        "pairs2": _pairs((None, 100)),
        "pairs_exact": f"""
SELECT trim(r.generated_sql) AS match_key, 1 AS match_tier, {_PAIR_COLUMNS}
FROM req r JOIN hist h ON trim(r.generated_sql) = h.cleaned_query_text""",
        "analyst": f"""
SELECT "timestamp", request_id, semantic_model_name, user_name, {_LATENCY} AS analyst_latency_ms,
  {_QUESTION} AS user_question, generated_sql, response_status_code
FROM request_log_raw WHERE response_status_code = 200 AND {window('"timestamp"')}""",
        "execs_all": f"""
SELECT query_id, query_text, query_tag, start_time, end_time, total_elapsed_time AS execution_time_ms,
  user_name, warehouse_name, execution_status
FROM query_history WHERE {window()} AND execution_status = 'SUCCESS'""",
        "execs": "SELECT * FROM execs_all WHERE query_text LIKE '%Generated by Assistant%'",
        "a_norm": f"SELECT *, {normalized_latency('generated_sql')} AS norm FROM analyst",
        "latency": _latency_join("execs_all"),
        "latency_marked": _latency_join("execs"),
        "tools": """
SELECT agent_name, tool_name,
  json_extract_string(spec, '$.tool_resources."' || tool_name || '".semantic_model_file') AS semantic_model_file
FROM (SELECT name AS agent_name, agent_spec AS spec,
        unnest(CASE WHEN json_valid(agent_spec) THEN json_keys(agent_spec, '$.tool_resources') END) AS tool_name
      FROM agents) x""",
        "agent_rows": f"""
SELECT "timestamp" AS event_time, CAST("timestamp" AS DATE) AS event_date,
  {_attribute('resource_attributes', 'user.name')} AS user_name,
  {_attribute('record_attributes', 'ai.observability.object.name')} AS agent_name,
  {_attribute('record_attributes', 'ai.observability.agent.planning.model')} AS model_name,
  {_token('input')} AS input_tokens, {_token('output')} AS output_tokens,
  {_token('cache_creation')} AS cache_write_tokens, {_token('cache_read')} AS cache_read_tokens,
  {_token('total')} AS total_tokens
FROM agent_events_raw""",
        "agent_queries": f"""
SELECT DISTINCT {_attribute('record_attributes', 'ai.observability.agent.tool.sql_execution.query_id')} AS query_id,
  {_attribute('resource_attributes', 'db.user')} AS user_name,
  {_attribute('record_attributes', 'ai.observability.object.name')} AS agent_name,
  CAST("timestamp" AS DATE) AS event_date
FROM agent_events_raw WHERE json_extract_string(record, '$.name') = 'SqlExecution'
  AND {_attribute('record_attributes', 'ai.observability.agent.tool.sql_execution.query_id')} IS NOT NULL""",
        "agent_events": f"SELECT * FROM agent_rows WHERE event_date >= DATE '{AS_OF}' - 30",
        "agent_queries_30": f"SELECT * FROM agent_queries WHERE event_date >= DATE '{AS_OF}' - 30",
        "qcosts": """
SELECT aq.query_id, aq.user_name, aq.agent_name, aq.event_date,
  qh.credits_used_cloud_services AS query_credits, qh.total_elapsed_time / 1000.0e0 AS elapsed_seconds,
  qh.warehouse_name, qh.warehouse_size
FROM agent_queries_30 aq LEFT JOIN query_history qh ON aq.query_id = qh.query_id""",
        "card_si": _card("SI"),
        "card_agent": _card("Agent"),
        "priced_si": _priced("card_si"),
        "priced_agent": _priced("card_agent"),
        "first_model": """
SELECT * FROM priced_si WHERE model_name IS NOT NULL""",
        "services": f"""
SELECT 'functions' AS service, start_time, {credits('token_credits')} AS credits FROM function_usage
UNION ALL SELECT 'analyst', start_time, {credits('credits')} FROM analyst_usage
UNION ALL SELECT 'documents', start_time, {credits('credits_used')} FROM document_usage
UNION ALL SELECT 'search', start_time, {credits('credits')} FROM search_usage""",
    }


_PAIR_COLUMNS = """h.query_id, h.query_text, h.start_time, h.total_elapsed_time, h.warehouse_name,
  h.user_name AS exec_user_name, h.credits_attributed_compute, h.cleaned_query_text,
  r."timestamp", r.request_id, r.semantic_model_name, r.tables_referenced, r.user_name, r.source, r.feedback,
  r.response_status_code, r.user_question, r.latency_ms, r.generated_sql, r.orchestration_path,
  r.question_category, r.verified_query_name, r.verified_query_question, r.query_type, r.request_credits,
  h.total_elapsed_time + r.latency_ms AS total_time,
  CAST(CAST(h.credits_attributed_compute AS DECIMAL(18,9)) + CAST(r.request_credits AS DECIMAL(18,9)) AS DOUBLE)
    AS total_credits"""


def _pairs(tiers: tuple[int | None, ...]) -> str:
    parts = []
    for i, n in enumerate(tiers, 1):
        h, r = ("h.norm", "r.norm") if n is None else (f"substr(h.norm, 1, {n})", f"substr(r.norm, 1, {n})")
        parts.append(
            f"SELECT {r} AS match_key, {i} AS match_tier, {_PAIR_COLUMNS} FROM r_norm r JOIN h_norm h ON {h} = {r} "
            "WHERE r.norm <> '' AND h.norm <> ''"
        )
    every = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({every}) x WHERE match_tier = (SELECT min(match_tier) FROM ({every}) y)"


def _latency_join(execs: str) -> str:
    return f"""
SELECT a."timestamp", a.request_id, a.semantic_model_name, a.user_name, a.analyst_latency_ms, a.user_question,
  a.generated_sql, a.response_status_code, e.query_id, e.query_text, e.execution_time_ms, e.warehouse_name,
  coalesce(a.analyst_latency_ms, 0) + coalesce(e.execution_time_ms, 0) AS total_latency_ms,
  a.analyst_latency_ms / 1000.0e0 AS analyst_latency_sec, e.execution_time_ms / 1000.0e0 AS execution_latency_sec,
  (coalesce(a.analyst_latency_ms, 0) + coalesce(e.execution_time_ms, 0)) / 1000.0e0 AS total_latency_sec
FROM a_norm a
LEFT JOIN (SELECT *, {normalized_latency('query_text')} AS norm FROM {execs}) e ON a.norm = e.norm AND e.norm <> ''
WHERE a.norm <> ''"""


def _card(kind: str) -> str:
    rows = ", ".join(f"('{m}', {', '.join(f'CAST({r} AS DECIMAL(9,4))' for r in rates)})" for m, *rates in RATE_CARDS[kind])
    return (
        f"SELECT * FROM (VALUES {rows}) v(model_name, input_rate, output_rate, cache_write_rate, cache_read_rate)"
    )


def _priced(card: str) -> str:
    def cost(kind: str) -> str:
        tokens, rate = f"coalesce({kind}_tokens, 0)", f"coalesce({kind}_rate, 0)"
        return f"CAST(CAST({tokens} * {rate} AS DECIMAL(28,4)) / 1000000 AS DECIMAL(18,9))"

    kinds = ("input", "output", "cache_write", "cache_read")
    columns = ", ".join(f"{cost(k)} AS {k}_credits" for k in kinds)
    return f"""
SELECT *, CAST(input_credits + output_credits + cache_write_credits + cache_read_credits AS DECIMAL(18,9))
  AS token_credits
FROM (SELECT e.*, {columns} FROM agent_events e LEFT JOIN {card} c ON e.model_name = c.model_name
      WHERE e.user_name IS NOT NULL) x"""


def oracle(name: str, sql: str, style: str = "mixed") -> None:
    """Register SQL with the CTEs it needs, in dependency order."""
    bodies = _derived(style)
    ordered: list[str] = []

    def visit(text: str) -> None:
        for cte in bodies:
            if cte not in ordered and re.search(rf"(?:FROM|JOIN)\s+{cte}\b", text):
                visit(bodies[cte])
                ordered.append(cte)

    visit(sql)
    ctes = ",\n".join(f"{cte} AS ({bodies[cte]})" for cte in ordered)
    ORACLE[name] = f"WITH {ctes}\n{sql}" if ctes else sql


# --- extraction -------------------------------------------------------------

_TWO_MODELS = "semantic_model_name IN ('@db.models/model_2.yaml', '@db.models/model_3.yaml')"
_ONE_MODEL = "semantic_model_name = '@db.models/model_2.yaml'"

oracle("request_log_extract", "SELECT * FROM req")
oracle("request_log_selected_models", f"SELECT * FROM req WHERE {_TWO_MODELS}")
oracle(
    "request_log_recent_mid_month",
    "SELECT * FROM req WHERE \"timestamp\" >= TIMESTAMP '2024-01-03 12:00:00' AND \"timestamp\" <= TIMESTAMP '2024-01-10 12:00:00'",
)
oracle("request_log_recent", f"SELECT * FROM req WHERE \"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
oracle("analyst_latency_data", f"SELECT * FROM analyst WHERE {_ONE_MODEL}")
oracle("analyst_latency_data_all", "SELECT * FROM analyst")
oracle("sql_execution_data", "SELECT * FROM execs")
oracle("agent_tool_models", "SELECT * FROM tools")
oracle("agent_tool_models_with_file", "SELECT * FROM tools WHERE semantic_model_file <> ''")
oracle("agent_catalog", "SELECT name AS agent_name, database_name AS db_name, schema_name AS sch_name FROM agents")
_AGENT_EVENTS = f"""SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM agent_rows
WHERE event_date >= DATE '{AS_OF}' - 20"""
oracle("agent_events", _AGENT_EVENTS)
oracle("agent_events_selected", f"{_AGENT_EVENTS} AND agent_name IN ('agent_0', 'agent_2', 'agent_4')")
oracle(
    "agent_sql_queries",
    f"""SELECT query_id, user_name, agent_name, CAST(event_date AS VARCHAR) AS event_date FROM agent_queries
WHERE event_date >= DATE '{AS_OF}' - 20""",
)

# --- text and scalar functions ---------------------------------------------

oracle("clean_query_text", f"SELECT query_id, {cleaned('query_text')} AS cleaned_query_text FROM query_history")
oracle(
    "normalize_sql",
    """SELECT request_id, norm AS normalized_sql, substr(norm, 1, 100) AS fragment_100,
  substr(norm, 1, 50) AS fragment_50 FROM r_norm""",
)
_REPAIRED = (
    "regexp_replace(regexp_replace({}, 'status\\s*=\\s*''active''', 'state = ''on''', 'g'), 'region\\b', 'area', 'g')"
).format(_trimmed("generated_sql"))
oracle(
    "normalize_sql_repaired",
    f"""SELECT request_id, rtrim(regexp_replace(upper({_REPAIRED}), '\\s+', ' ', 'g'), ';') AS normalized_sql
FROM req""",
)
oracle(
    "normalize_sql_latency",
    f"SELECT request_id, {normalized_latency('generated_sql')} AS normalized_sql FROM req",
)
oracle(
    "period_starts",
    f"""SELECT DISTINCT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, CAST(DATE '{AS_OF}' AS VARCHAR) AS day_start,
  CAST(CAST(date_trunc('week', DATE '{AS_OF}') AS DATE) AS VARCHAR) AS week_start,
  CAST(CAST(date_trunc('month', DATE '{AS_OF}') AS DATE) AS VARCHAR) AS month_start FROM function_usage""",
)
oracle(
    "events_last_7_days",
    f"""SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, COUNT(*) AS rows FROM function_usage
WHERE start_time >= DATE '{AS_OF}' - 7 AND start_time < DATE '{AS_OF}' + 1 GROUP BY 1""",
)
oracle(
    "latency_seconds",
    f"""SELECT request_id, latency_ms / 1000.0e0 AS seconds, {half_even('latency_ms / 1000.0e0', 2)} AS seconds_rounded,
  {dbl('coalesce(latency_ms, 0) + 5')} AS total_latency, {dbl('latency_ms + 5')} AS total_time FROM req""",
)

# --- joins ------------------------------------------------------------------

oracle("query_history_cost", "SELECT * FROM hist")
oracle(
    "query_history_cost_left",
    f"""SELECT qh.query_id, query_text, query_tag, start_time, total_elapsed_time, warehouse_name, user_name,
  coalesce(credits_attributed_compute, 0) AS credits_attributed_compute, {cleaned('query_text')} AS cleaned_query_text
FROM query_history qh LEFT JOIN query_attribution qa ON qh.query_id = qa.query_id
WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  AND (query_tag = 'ai-agent' OR query_text ILIKE '%from t_1_ %' OR query_text ILIKE '%c_7 %')""",
)
oracle("attribute_requests", "SELECT * FROM pairs")
oracle("attribute_requests_one_plan", "SELECT * FROM pairs")
oracle("attribute_requests_prefix_100", "SELECT * FROM pairs", style="commented")
oracle("attribute_requests_prefix_50", "SELECT * FROM pairs", style="reworded")
oracle("attribute_requests_two_tiers", "SELECT * FROM pairs2", style="commented")
oracle("attribute_requests_no_match", "SELECT * FROM pairs2", style="reworded")
oracle("attribute_requests_exact", "SELECT * FROM pairs_exact")
oracle("join_latency", "SELECT * FROM latency")
oracle("join_latency_marked", "SELECT * FROM latency_marked")
oracle(
    "functions_query_history",
    f"""SELECT q.query_id, model_name, function_name, tokens, token_credits, query_text, user_name, role_name,
  total_elapsed_time FROM function_query_usage c JOIN query_history q ON c.query_id = q.query_id
WHERE {window('q.start_time')}""",
)
oracle("agent_query_costs", "SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM qcosts")
oracle(
    "join_diagnostics",
    f"""SELECT (SELECT COUNT(*) FROM h_norm WHERE norm <> '') AS history_rows,
  (SELECT COUNT(*) FROM r_norm WHERE norm <> '') AS log_rows,
  (SELECT COUNT(DISTINCT norm) FROM h_norm WHERE norm <> '') AS history_keys,
  (SELECT COUNT(DISTINCT norm) FROM r_norm WHERE norm <> '') AS log_keys,
  (SELECT COUNT(*) FROM (SELECT norm FROM h_norm WHERE norm <> '' INTERSECT SELECT norm FROM r_norm) i) AS shared_keys,
  (SELECT COUNT(*) FROM pairs) AS matched_pairs,
  {half_even('(SELECT COUNT(*) FROM pairs) / (SELECT COUNT(*) FROM req) * 100.0e0', 1)} AS match_rate""",
)

# --- request log rollups ----------------------------------------------------

oracle(
    "verified_query_count",
    f"""SELECT semantic_model_name, query_type, COUNT(*) AS request_count,
  {half_even('COUNT(*) * 100.0e0 / SUM(COUNT(*)) OVER (PARTITION BY semantic_model_name)', 2)} AS percentage
FROM req WHERE semantic_model_name IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "top_verified_queries",
    f"""SELECT * EXCLUDE (place) FROM (
  SELECT semantic_model_name, verified_query_name, verified_query_question, COUNT(*) AS frequency,
    {half_even('COUNT(*) * 100.0e0 / SUM(COUNT(*)) OVER (PARTITION BY semantic_model_name)', 2)}
      AS percentage_of_verified_queries,
    row_number() OVER (PARTITION BY semantic_model_name
      ORDER BY COUNT(*) DESC, verified_query_name, verified_query_question) AS place
  FROM req WHERE query_type = 'Verified Query' AND semantic_model_name IS NOT NULL
    AND verified_query_name IS NOT NULL AND verified_query_question IS NOT NULL
  GROUP BY 1, 2, 3) x WHERE place <= 3""",
)
oracle(
    "slowest_queries",
    f"""SELECT * EXCLUDE (place) FROM (
  SELECT semantic_model_name, user_question, latency_seconds, orchestration_path, question_category,
    row_number() OVER (PARTITION BY semantic_model_name ORDER BY latency_seconds DESC, request_id) AS place
  FROM (SELECT *, {half_even('latency_ms / 1000.0e0', 2)} AS latency_seconds FROM req) r
  WHERE latency_ms IS NOT NULL AND semantic_model_name IS NOT NULL) x WHERE place <= 10""",
)
oracle(
    "latency_summary",
    f"""SELECT semantic_model_name, COUNT(*) AS query_count, {half_even('AVG(c) / 100.0e0', 2)} AS avg_latency_seconds,
  {half_even('median(c) / 100.0e0', 2)} AS median_latency_seconds, {half_even('MIN(c) / 100.0e0', 2)}
    AS min_latency_seconds, {half_even('MAX(c) / 100.0e0', 2)} AS max_latency_seconds
FROM (SELECT semantic_model_name, round_even(latency_ms / 1000.0e0 * 100.0e0, 0) AS c FROM req
      WHERE latency_ms IS NOT NULL AND semantic_model_name IS NOT NULL) x GROUP BY 1""",
)
oracle(
    "user_activity",
    f"""SELECT user_name, semantic_model_name, COUNT(request_id) AS queries_count,
  {half_even('AVG(latency_ms)', 2)} AS avg_latency_ms, {half_even(csum('request_credits'), 2)} AS total_credits,
  {half_even('COUNT(request_id) / CAST(SUM(COUNT(request_id)) OVER (PARTITION BY user_name) AS DOUBLE) * 100.0e0', 2)}
    AS percentage_of_user_queries
FROM req WHERE user_name IS NOT NULL AND semantic_model_name IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "model_usage_summary",
    f"""SELECT semantic_model_name, COUNT(request_id) AS total_queries, COUNT(DISTINCT user_name) AS unique_users,
  {half_even('AVG(latency_ms)', 2)} AS avg_latency_ms, {half_even(csum('request_credits'), 2)} AS total_request_credits,
  {half_even('COUNT(request_id) / CAST(SUM(COUNT(request_id)) OVER () AS DOUBLE) * 100.0e0', 2)} AS percentage
FROM req WHERE semantic_model_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "query_type_view",
    f"""SELECT semantic_model_name, query_type, request_count,
  {ratio_half_up('request_count * 100', 'SUM(request_count) OVER (PARTITION BY semantic_model_name)', 2)} AS percentage,
  {ratio_half_up('latency', 'timed', 2)} AS avg_latency_ms, total_request_credits
FROM (SELECT semantic_model_name, query_type, COUNT(*) AS request_count, SUM(latency_ms) AS latency,
        COUNT(latency_ms) AS timed, {dbl(csum('request_credits'))} AS total_request_credits
      FROM req GROUP BY 1, 2) x""",
)
oracle(
    "daily_usage_by_model",
    """SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, semantic_model_name, COUNT(request_id) AS queries_count,
  COUNT(DISTINCT user_name) AS unique_users FROM req WHERE semantic_model_name IS NOT NULL GROUP BY 1, 2""",
)
oracle(
    "log_coverage",
    """SELECT semantic_model_name, COUNT(*) AS log_count, MIN("timestamp") AS earliest_log,
  MAX("timestamp") AS latest_log FROM req GROUP BY 1""",
)
oracle(
    "query_type_share",
    f"""SELECT query_type, count, {ratio_half_up('count * 100', 'SUM(count) OVER ()', 2)} AS percentage
FROM (SELECT query_type, COUNT(*) AS count FROM req GROUP BY 1) x""",
)
oracle(
    "query_type_pivot",
    """SELECT semantic_model_name, COUNT(*) FILTER (query_type = 'Non-Verified Query') AS non_verified_queries,
  COUNT(*) FILTER (query_type = 'Verified Query') AS verified_queries
FROM req WHERE semantic_model_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "table_row_counts",
    """SELECT 'request_log' AS table_name, COUNT(*) AS row_count FROM request_log_raw
UNION ALL SELECT 'query_history_cost', COUNT(*) FROM hist""",
)

# --- cost rollups -----------------------------------------------------------

_MODEL_COSTS = f"""SELECT semantic_model_name, {half_even(csum('total_credits'), 4)} AS total_credits
FROM pairs WHERE semantic_model_name IS NOT NULL GROUP BY 1"""
_BREAKDOWN = f"""SELECT *,
  {half_even('total_credits / CAST(SUM(CAST(total_credits AS DECIMAL(20,4))) OVER () AS DOUBLE) * 100.0e0', 2)}
    AS percentage_of_total_cost,
  {half_even('total_credits / query_count', 4)} AS avg_credits_per_query
FROM (SELECT semantic_model_name, {half_even(csum('request_credits'), 4)} AS request_credits,
        {half_even(csum('credits_attributed_compute'), 4)} AS warehouse_credits,
        {half_even(csum('total_credits'), 4)} AS total_credits, COUNT(request_id) AS query_count
      FROM pairs WHERE semantic_model_name IS NOT NULL GROUP BY 1) x"""
_AGENT_COSTS = f"""SELECT agent_name, {half_even(csum('total_credits'), 4)} AS total_credits,
  COUNT(tool_name) AS tool_count
FROM tools t JOIN ({_MODEL_COSTS}) c ON t.semantic_model_file = c.semantic_model_name GROUP BY 1"""

oracle("total_cost_by_model", _MODEL_COSTS)
oracle("cost_breakdown_by_model", _BREAKDOWN)
oracle("cost_breakdown_prefix_100", _BREAKDOWN, style="commented")
oracle("cost_by_agent", _AGENT_COSTS)
oracle("total_agent_cost", f"SELECT {dbl(csum('total_credits'))} AS total_agent_credits FROM ({_AGENT_COSTS}) x")
_SUMMARY = f"""SELECT semantic_model_name, query_count, unique_users, total_request_credits, total_warehouse_credits,
  total_combined_credits, {ratio_half_up('latency', 'timed', 2)} AS avg_latency_ms,
  {ratio_half_up('total', 'query_count * 1000000', 4)} AS avg_credits_per_query,
  {ratio_half_up('total * 100', 'SUM(total) OVER ()', 2)} AS percentage_of_total_cost
FROM (SELECT semantic_model_name, COUNT(*) AS query_count, COUNT(DISTINCT user_name) AS unique_users,
        {dbl(csum('request_credits'))} AS total_request_credits,
        {dbl(csum('credits_attributed_compute'))} AS total_warehouse_credits,
        {dbl(csum('total_credits'))} AS total_combined_credits, SUM({micro('total_credits')}) AS total,
        SUM(latency_ms) AS latency, COUNT(latency_ms) AS timed
      FROM pairs_exact GROUP BY 1) x"""
oracle("cost_summary_view", _SUMMARY)
oracle(
    "cost_summary_view_sample",
    f"{_SUMMARY} ORDER BY total_combined_credits DESC NULLS LAST, semantic_model_name NULLS LAST LIMIT 5",
)
oracle(
    "user_activity_view",
    f"""SELECT user_name, semantic_model_name, queries_count, {ratio_half_up('latency', 'timed', 2)} AS avg_latency_ms,
  total_credits, {ratio_half_up('queries_count * 100', 'SUM(queries_count) OVER (PARTITION BY user_name)', 2)}
    AS percentage_of_user_queries
FROM (SELECT user_name, semantic_model_name, COUNT(*) AS queries_count, SUM(latency_ms) AS latency,
        COUNT(latency_ms) AS timed, {dbl(csum('total_credits'))} AS total_credits
      FROM pairs_exact GROUP BY 1, 2) x""",
)
oracle(
    "cost_by_user",
    f"""SELECT user_name, {dbl(csum('credits_attributed_compute'))} AS credits_attributed_compute,
  {dbl(csum('total_credits'))} AS total_credits FROM pairs WHERE user_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "attributed_total",
    f"SELECT {half_even(csum('credits_attributed_compute'), 4)} AS total_credits_attributed_compute FROM pairs",
)


def _describe(measure: str, column: str) -> str:
    return f"""SELECT '{measure}' AS measure, COUNT(v) AS count, round(AVG(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  MIN(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75,
  MAX(v) AS max FROM (SELECT {dbl(column)} AS v FROM pairs) x"""


oracle(
    "latency_describe",
    f"{_describe('generation_ms', 'latency_ms')} UNION ALL {_describe('execution_ms', 'total_elapsed_time')}",
)
oracle("mean_total_time", f"SELECT {big('round_even(AVG(total_time), 0)')} AS avg_total_time_ms FROM pairs")
oracle(
    "user_activity_joined",
    f"""SELECT user_name, COUNT(query_id) AS total_queries, AVG(latency_ms) AS avg_latency_ms,
  {dbl(csum('credits_attributed_compute'))} AS credits_attributed_compute
FROM pairs WHERE user_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "daily_usage",
    'SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, COUNT(query_id) AS query_count FROM pairs GROUP BY 1',
)
oracle(
    "model_value_counts",
    "SELECT semantic_model_name, COUNT(*) AS count FROM pairs WHERE semantic_model_name IS NOT NULL GROUP BY 1",
)
oracle(
    "agent_inventory",
    """SELECT COUNT(DISTINCT agent_name) AS agents, COUNT(DISTINCT semantic_model_file) AS semantic_models,
  COUNT(*) AS configurations FROM tools""",
)

# --- usage rollups ----------------------------------------------------------

_AI = "service_type = 'AI_SERVICES'"
_ORDERS_WINDOW = window("start_time", ORDERS_START, ORDERS_END)
_LAST_7 = f"start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"


def total(x: str, digits: int) -> str:
    return half_up(csum(x), digits)


oracle(
    "ai_services_total",
    f"""SELECT coalesce({total('credits_used', 2)}, 0) AS total_credits FROM metering
WHERE {_ORDERS_WINDOW} AND {_AI}""",
)
oracle(
    "ai_services_total_days",
    f"""SELECT coalesce({total('credits_used', 2)}, 0) AS total_credits FROM metering
WHERE start_time >= TIMESTAMP '2001-07-15' - INTERVAL 365 DAY AND start_time < DATE '2001-07-16' AND {_AI}""",
)
_LLM = f"SELECT {total('token_credits', 0)} AS llm_inference_credits, {big('SUM(tokens)')} AS llm_inference_tokens"
oracle("llm_summary", f"{_LLM} FROM function_usage WHERE {window()} AND function_name = 'COMPLETE'")
oracle("llm_summary_all_functions", f"{_LLM} FROM function_usage WHERE {window()}")
oracle(
    "llm_summary_days",
    f"""SELECT {total('credits_used', 2)} AS llm_inference_credits,
  {big('SUM(input_tokens + output_tokens)')} AS llm_inference_tokens
FROM function_usage WHERE {_LAST_7} AND function_name = 'COMPLETE'""",
)
oracle(
    "analyst_summary",
    f"""SELECT {total('credits', 0)} AS analyst_credits, {big('SUM(request_count)')} AS number_messages
FROM analyst_usage WHERE {window()}""",
)
oracle(
    "analyst_summary_days",
    f"""SELECT {total('credits_attributed', 2)} AS analyst_credits, COUNT(*) AS number_messages
FROM analyst_usage WHERE {_LAST_7}""",
)
oracle("document_credits", f"SELECT {total('credits_used', 2)} AS total_credits FROM document_usage WHERE {window()}")
_FUNCTIONS = f"SELECT {total('token_credits', 2)} AS total_credits FROM function_usage"
oracle("functions_total", f"{_FUNCTIONS} WHERE {window()}")
oracle("functions_total_empty_window", f"{_FUNCTIONS} WHERE {_ORDERS_WINDOW}")
oracle(
    "credits_by_function",
    f"""SELECT function_name, {total('token_credits', 2)} AS total_credits FROM function_usage
WHERE {window()} GROUP BY 1""",
)
oracle(
    "credits_by_model",
    f"""SELECT model_name, {dbl(csum('token_credits'))} AS total_credits_used, {big('SUM(tokens)')} AS total_tokens_used
FROM function_usage WHERE {window()} AND function_name = 'COMPLETE' GROUP BY 1
ORDER BY total_credits_used DESC NULLS LAST, model_name LIMIT 5""",
)
oracle("search_total", f"SELECT {total('credits', 2)} AS search_credits FROM search_usage WHERE {window()}")
oracle(
    "search_by_service",
    f"""SELECT service_name, {dbl(csum('credits'))} AS total_credits FROM search_usage
WHERE {window()} GROUP BY 1""",
)
oracle(
    "credits_by_warehouse",
    f"""SELECT warehouse_name, w.warehouse_id, {dbl(csum('token_credits'))} AS function_credits,
  {dbl(csum('credits_used_compute'))} AS compute_credits
FROM warehouse_metering w JOIN function_usage c ON c.warehouse_id = w.warehouse_id
WHERE {window('c.start_time')} GROUP BY 1, 2""",
)
oracle(
    "credits_by_warehouse_plain",
    f"""SELECT warehouse_name, m.warehouse_id, function_credits, compute_credits
FROM (SELECT warehouse_name, warehouse_id, {dbl(csum('credits_used_compute'))} AS compute_credits
      FROM warehouse_metering GROUP BY 1, 2) m
JOIN (SELECT warehouse_id, {dbl(csum('token_credits'))} AS function_credits
      FROM function_usage WHERE {window()} GROUP BY 1) u ON m.warehouse_id = u.warehouse_id""",
)
_DAY = "CAST(CAST(start_time AS DATE) AS VARCHAR)"
oracle(
    "analyst_by_day",
    f"""SELECT {_DAY} AS day, {big('SUM(request_count)')} AS total_request_count FROM analyst_usage
WHERE {window()} GROUP BY 1""",
)
oracle(
    "document_metrics",
    f"""SELECT {total('credits_used', 2)} AS total_credits, {big('SUM(page_count)')} AS total_pages,
  {big('SUM(document_count)')} AS total_documents FROM document_usage WHERE {window()}""",
)
oracle(
    "document_by_day",
    f"""SELECT {_DAY} AS day, {total('credits_used', 2)} AS daily_credits, {big('SUM(page_count)')} AS daily_pages,
  {big('SUM(document_count)')} AS daily_documents FROM document_usage WHERE {window()} GROUP BY 1""",
)
oracle(
    "search_by_day",
    f"SELECT {_DAY} AS day, {total('credits', 2)} AS daily_credits FROM search_usage WHERE {window()} GROUP BY 1",
)
oracle(
    "service_overview",
    f"""SELECT service, CAST(round(SUM(credits), CASE service WHEN 'analyst' THEN 0 ELSE 2 END) AS DOUBLE) AS credits
FROM services WHERE {window()} GROUP BY 1 HAVING SUM(credits) > 0""".replace(
        "CAST(round(SUM(credits), CASE service WHEN 'analyst' THEN 0 ELSE 2 END) AS DOUBLE)",
        "CASE service WHEN 'analyst' THEN CAST(round(SUM(credits), 0) AS DOUBLE) "
        "ELSE CAST(round(SUM(credits), 2) AS DOUBLE) END",
    ),
)
oracle(
    "overview_headline",
    f"""SELECT (SELECT coalesce({total('credits_used', 2)}, 0) FROM metering WHERE {window()} AND {_AI})
    AS total_ai_credits,
  (SELECT {total('token_credits', 0)} FROM function_usage WHERE {window()} AND function_name = 'COMPLETE')
    AS llm_inference_credits,
  (SELECT {big('SUM(tokens)')} FROM function_usage WHERE {window()} AND function_name = 'COMPLETE')
    AS llm_inference_tokens,
  (SELECT {big('SUM(request_count)')} FROM analyst_usage WHERE {window()}) AS number_messages""",
)
_THIS_MONTH = f"start_time >= TIMESTAMP '2001-07-01' AND start_time < DATE '2001-07-16' AND {_AI}"
oracle(
    "daily_spend",
    f"""SELECT service_type, {_DAY} AS usage_date, {dbl(csum('credits_used'))} AS daily_credits FROM metering
WHERE {_THIS_MONTH} GROUP BY 1, 2""",
)
oracle(
    "top_spend_days",
    f"""SELECT {_DAY} AS usage_date, {dbl(csum('credits_used'))} AS total_credits, COUNT(*) AS usage_events
FROM metering WHERE {_THIS_MONTH} GROUP BY 1 ORDER BY total_credits DESC, usage_date LIMIT 10""",
)
oracle(
    "run_history",
    """SELECT * FROM scheduled_runs WHERE name LIKE '%AI%MONITOR%' ORDER BY scheduled_time DESC, name LIMIT 20""",
)

# --- latency report ---------------------------------------------------------


def _stats(ms: str) -> str:
    return f"""{half_even(f'AVG({ms}) / 1000.0e0', 2)} AS avg_latency_sec,
  {half_even(f'median({dbl(ms)}) / 1000.0e0', 2)} AS median_latency_sec,
  {half_even(f'MAX({ms}) / 1000.0e0', 2)} AS max_latency_sec"""


def _headline(ms: str) -> str:
    return f"""SELECT COUNT(*) AS row_count, AVG({ms}) / 1000.0e0 AS avg_latency_sec,
  median({dbl(ms)}) / 1000.0e0 AS median_latency_sec, MAX({ms}) / 1000.0e0 AS max_latency_sec"""


oracle(
    "gen_breakdown",
    f"""SELECT semantic_model_name, COUNT(request_id) AS request_count, {_stats('analyst_latency_ms')}
FROM analyst WHERE semantic_model_name IS NOT NULL GROUP BY 1""",
)
oracle("gen_headline", f"{_headline('analyst_latency_ms')} FROM analyst")
oracle("gen_headline_one_model", f"{_headline('analyst_latency_ms')} FROM analyst WHERE {_ONE_MODEL}")
oracle("gen_series", 'SELECT "timestamp", analyst_latency_ms / 1000.0e0 AS analyst_latency_sec FROM analyst')
oracle(
    "slowest_requests",
    """SELECT "timestamp", request_id, user_question, generated_sql,
  analyst_latency_ms / 1000.0e0 AS analyst_latency_sec, user_name, semantic_model_name FROM analyst
ORDER BY analyst_latency_ms DESC NULLS LAST, "timestamp" DESC, request_id LIMIT 10""",
)
oracle("model_choices", "SELECT DISTINCT semantic_model_name FROM analyst WHERE semantic_model_name IS NOT NULL")
oracle("exec_headline", f"{_headline('execution_time_ms')} FROM execs")
oracle(
    "exec_headline_filtered",
    f"""{_headline('execution_time_ms')} FROM execs
WHERE query_tag = 'ai-agent' AND warehouse_name IN ('WH_1', 'WH_2')""",
)
oracle("exec_series", "SELECT start_time, execution_time_ms / 1000.0e0 AS execution_latency_sec FROM execs")
oracle(
    "query_tag_distribution",
    "SELECT query_tag, COUNT(*) AS count FROM execs WHERE query_tag IS NOT NULL GROUP BY 1",
)
oracle(
    "warehouse_distribution",
    f"""SELECT warehouse_name, COUNT(query_id) AS query_count, {_stats('execution_time_ms')}
FROM execs WHERE warehouse_name IS NOT NULL GROUP BY 1""",
)
_EXEC_SECONDS = "execution_time_ms / 1000.0e0 AS execution_latency_sec"
oracle(
    "slowest_executions",
    f"""SELECT start_time, query_id, query_tag, query_text, {_EXEC_SECONDS}, user_name, warehouse_name FROM execs
ORDER BY execution_time_ms DESC NULLS LAST, start_time DESC, query_id LIMIT 10""",
)
oracle(
    "exec_detail",
    f"""SELECT start_time, query_id, query_tag, query_text, {_EXEC_SECONDS}, user_name, warehouse_name,
  execution_status FROM execs""",
)
oracle(
    "combined_headline",
    """SELECT COUNT(*) AS joined_rows, COUNT(query_id) AS matched_rows,
  AVG(analyst_latency_ms) / 1000.0e0 AS avg_generation_sec, AVG(execution_time_ms) / 1000.0e0 AS avg_execution_sec,
  AVG(total_latency_ms) / 1000.0e0 AS avg_total_sec FROM latency""",
)
_PARTS = """(SELECT coalesce(SUM(analyst_latency_ms), 0) AS gen, coalesce(SUM(execution_time_ms), 0) AS exec
  FROM latency WHERE query_id IS NOT NULL) x"""


def _part(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS component,
  coalesce({dbl(column)} / nullif({dbl('gen + exec')}, 0) * 100.0e0, 0) AS percentage,
  {dbl(column)} / 1000.0e0 AS total_time_sec FROM {_PARTS}"""


oracle("latency_composition", f"{_part('SQL Generation', 'gen')} UNION ALL {_part('SQL Execution', 'exec')}")
oracle(
    "slowest_combined",
    """SELECT request_id, query_id, user_question, generated_sql, analyst_latency_sec, execution_latency_sec,
  total_latency_sec, warehouse_name, semantic_model_name FROM latency
ORDER BY total_latency_ms DESC, request_id NULLS FIRST, query_id NULLS FIRST LIMIT 10""",
)
oracle("combined_series", "SELECT analyst_latency_sec, execution_latency_sec FROM latency")

# --- agent costs ------------------------------------------------------------

_KINDS = ("input", "output", "cache_write", "cache_read")
_PRICED = (
    "SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date, "
    + ", ".join(f"CAST({k}_credits AS DOUBLE) AS {k}_credits" for k in (*_KINDS, "token"))
    + ") FROM priced_{}"
)
_SUM_TOKENS = f"""{dbl('SUM(token_credits)')} AS token_credits, {big('coalesce(SUM(input_tokens), 0)')} AS input_tokens,
  {big('coalesce(SUM(output_tokens), 0)')} AS output_tokens"""
_FIRST = "arg_min(model_name, event_time) FILTER (model_name IS NOT NULL) AS model_name"

oracle("price_tokens_si", _PRICED.format("si"))
oracle("price_tokens_agent", _PRICED.format("agent"))
oracle("user_choices", "SELECT DISTINCT user_name FROM agent_events WHERE user_name IS NOT NULL")
oracle(
    "agent_headline",
    f"""SELECT {dbl('token + query')} AS total_credits, {dbl('token')} AS token_credits, {dbl('query')} AS query_credits,
  unique_agents
FROM (SELECT (SELECT SUM(token_credits) FROM priced_si) AS token,
        (SELECT {csum('query_credits')} FROM qcosts) AS query,
        (SELECT COUNT(DISTINCT agent_name) FROM priced_si) AS unique_agents) x""",
)
oracle(
    "token_breakdown",
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, {dbl(f'SUM({k}_credits)')} AS credits FROM priced_si" for k in _KINDS
    ),
)
oracle(
    "agent_combined",
    f"""SELECT t.agent_name, {dbl('token')} AS token_credits, {dbl('coalesce(query, 0)')} AS query_credits,
  {dbl('token + coalesce(query, 0)')} AS total_credits
FROM (SELECT agent_name, SUM(token_credits) AS token FROM priced_si WHERE agent_name IS NOT NULL GROUP BY 1) t
LEFT JOIN (SELECT agent_name, {csum('query_credits')} AS query FROM qcosts GROUP BY 1) q ON t.agent_name = q.agent_name""",
)
oracle(
    "agent_query_summary",
    f"""SELECT agent_name, COUNT(query_id) AS query_count,
  {dbl(f"coalesce({csum('query_credits')}, 0)")} AS total_query_credits,
  {dbl(f"coalesce({csum('elapsed_seconds')}, 0)")} AS total_elapsed_seconds
FROM qcosts WHERE agent_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "agent_cost_by_user",
    f"SELECT user_name, {_SUM_TOKENS}, COUNT(agent_name) AS request_count FROM priced_si GROUP BY 1",
)
oracle(
    "agent_cost_by_agent",
    f"""SELECT agent_name, {_SUM_TOKENS}, COUNT(DISTINCT user_name) AS unique_users, {_FIRST}
FROM priced_si WHERE agent_name IS NOT NULL GROUP BY 1""",
)
oracle(
    "agent_cost_daily",
    f"""SELECT CAST(event_date AS VARCHAR) AS event_date, {dbl('SUM(token_credits)')} AS token_credits,
  {dbl('SUM(input_credits)')} AS input_credits, {dbl('SUM(output_credits)')} AS output_credits,
  COUNT(user_name) AS request_count FROM priced_si GROUP BY 1""",
)
oracle(
    "agent_cost_detail",
    f"""SELECT user_name, agent_name, CAST(event_date AS VARCHAR) AS event_date, {_SUM_TOKENS}, {_FIRST}
FROM priced_si WHERE agent_name IS NOT NULL GROUP BY 1, 2, 3""",
)
_RATES = "model_name, CAST(input_rate AS DOUBLE) AS input_rate, CAST(output_rate AS DOUBLE) AS output_rate, " \
    "CAST(cache_write_rate AS DOUBLE) AS cache_write_rate, CAST(cache_read_rate AS DOUBLE) AS cache_read_rate"
oracle(
    "rate_cards",
    f"""SELECT r.*, u.events FROM (SELECT 'Agent' AS card, {_RATES} FROM card_agent
  UNION ALL SELECT 'SI', {_RATES} FROM card_si) r
JOIN (SELECT model_name, COUNT(*) AS events FROM agent_events GROUP BY 1) u ON r.model_name = u.model_name""",
)

# --- budgets ----------------------------------------------------------------

_WEEK_START, _MONTH_START = "2024-01-29", "2024-01-01"
_SINCE = {"DAY": AS_OF, "WEEK": _WEEK_START, "MONTH": _MONTH_START}


def _service(service: str, since: str) -> str:
    return f"(SELECT coalesce(SUM(credits), 0) FROM services WHERE service = '{service}' AND start_time >= DATE '{since}')"


def _two(x: str) -> str:
    return f"printf('%.2f', {dbl(x)})"


def _alert(period: str, limit: float, chosen: tuple[str, ...]) -> str:
    since = _SINCE[period]
    names = ("functions", "analyst", "documents", "search")
    parts = ", ".join(f"{_service(s, since) if s in chosen else '0'} AS {s}" for s in names)
    breakdown = " || ".join(f"'{s}: ' || {_two(s)} || ' credits' || chr(10)" for s in chosen)
    return f"""SELECT '{period}' AS period, '{since}' AS period_start, {limit}::DOUBLE AS "limit",
  {', '.join(f'{dbl(s)} AS {s}_credits' for s in names)}, {dbl('total')} AS total_credits,
  total >= {limit} AS triggered,
  'AI services budget alert' || chr(10) || 'Period: {period} (since {since})' || chr(10)
  || 'Alert threshold: ' || printf('%.2f', {limit}::DOUBLE) || ' credits' || chr(10)
  || 'Current usage: ' || {_two('total')} || ' credits' || chr(10) || 'Service breakdown:' || chr(10) || {breakdown}
  || CASE WHEN total >= {limit} THEN 'ALERT: usage has reached the threshold'
     ELSE 'Usage is within budget limits' END AS message
FROM (SELECT *, {' + '.join(chosen)} AS total FROM (SELECT {parts}) x) y"""


_ALL = ("functions", "analyst", "documents", "search")
oracle("budget_alert_month", _alert("MONTH", 10, _ALL))
oracle("budget_alert_week_two_services", _alert("WEEK", 500, ("functions", "analyst")))
oracle("budget_alert_day", _alert("DAY", 0.01, _ALL))
oracle(
    "functions_budget",
    f"""SELECT 'MONTH' AS period, '{_MONTH_START}' AS period_start, 1000::DOUBLE AS "limit",
  {dbl('used')} AS current_usage_credits, used >= 1000 AS triggered,
  'function credit usage in this MONTH = ' || {_two('used')} AS message
FROM (SELECT {_service('functions', _MONTH_START)} AS used) x""",
)

oracle(
    "functions_budget_mid_month",
    f"""SELECT 'DAY' AS period, '2024-01-10' AS period_start, 1::DOUBLE AS "limit",
  {dbl('used')} AS current_usage_credits, used >= 1 AS triggered,
  'function credit usage in this DAY = ' || {_two('used')} AS message
FROM (SELECT coalesce(SUM(credits), 0) AS used FROM services
      WHERE service = 'functions' AND start_time >= DATE '2024-01-10' AND start_time < DATE '2024-01-11') x""",
)


def _custom(period: str, since: str, limit: int) -> str:
    share = ratio_half_up("used * 100", f"{limit} * CAST(1000000000 AS HUGEINT)", 2)
    status = f"CASE WHEN used >= {limit} * CAST(1000000000 AS HUGEINT) THEN 'EXCEEDED' " \
        f"WHEN used * 100 >= {limit} * CAST(80000000000 AS HUGEINT) THEN 'WARNING' ELSE 'OK' END"
    return f"""SELECT 'Acme Corporation' AS organization, '{period}' AS period, '{since}' AS period_start,
  {limit}::DOUBLE AS "limit", total_credits, percentage_used, status,
  'Acme Corporation AI services budget report' || chr(10) || 'Period: {period} (since {since})' || chr(10)
  || 'Alert threshold: ' || printf('%.2f', {limit}::DOUBLE) || ' credits' || chr(10)
  || 'Current usage: ' || printf('%.2f', total_credits) || ' credits' || chr(10)
  || 'Usage percentage: ' || printf('%.2f', percentage_used) || '%' || chr(10)
  || CASE status WHEN 'EXCEEDED' THEN 'Budget exceeded: act now' WHEN 'WARNING' THEN
     'Warning: 80% of the budget is used' ELSE 'Budget usage is within normal limits' END AS message
FROM (SELECT total_credits, {share} AS percentage_used, {status} AS status
      FROM (SELECT {dbl(f"coalesce({csum('credits_used')}, 0)")} AS total_credits,
              coalesce(SUM(CAST(round(credits_used * 1000000000.0e0) AS HUGEINT)), 0) AS used
            FROM metering WHERE start_time >= DATE '{since}' AND start_time < DATE '2001-07-16' AND {_AI}) x) y"""


oracle("custom_budget_alert", _custom("MONTH", "2001-07-01", 1000))
oracle("custom_budget_alert_ok", _custom("WEEK", "2001-07-09", 100000000))


def _rule(rule: tuple) -> str:
    name, period, limit, *toggles = rule
    chosen = [s for s, on in zip(_ALL, toggles) if on]
    used = " + ".join(_service(s, _SINCE[period]) for s in chosen)
    return f"SELECT '{name}' AS rule, '{period}' AS period, '{_SINCE[period]}' AS period_start, {limit}::DOUBLE AS \"limit\", {used} AS used"


oracle(
    "budget_tiers",
    f"""SELECT rule, period, period_start, "limit", {dbl('used')} AS total_credits, {dbl('used')} >= "limit" AS triggered,
  CASE WHEN {dbl('used')} >= "limit" THEN 'EXCEEDED' WHEN {dbl('used')} * 100 / "limit" >= 80 THEN 'WARNING' ELSE 'OK' END
    AS status,
  rule || ': ' || {_two('used')} || ' of ' || printf('%.2f', "limit") || ' credits' AS message
FROM ({' UNION ALL '.join(_rule(r) for r in EXAMPLE_RULES)}) x""",
)

# --- tables and streams -----------------------------------------------------

oracle("append_logs_result", "SELECT * FROM req WHERE semantic_model_name IS NOT NULL")
oracle("log_ingest_result", "SELECT * FROM req WHERE semantic_model_name IS NOT NULL")
oracle("load_logs_result", "SELECT * FROM req UNION ALL SELECT * FROM req WHERE response_status_code = 500")
oracle("build_query_history_result", "SELECT * FROM hist")


def _reached(rule: tuple) -> str:
    name, period, limit, *toggles = rule
    chosen = ", ".join(f"'{s}'" for s, on in zip(_ALL, toggles) if on)
    start = f"CAST(date_trunc('{period.lower()}', start_time) AS DATE)"
    return f"""SELECT '{name}' AS rule, '{period}' AS period, CAST({start} AS VARCHAR) AS period_start, {limit}::DOUBLE AS "limit",
  true AS reached FROM services WHERE service IN ({chosen}) GROUP BY {start} HAVING {dbl('SUM(credits)')} >= {limit}::DOUBLE"""


oracle("budget_stream_alerts", " UNION ALL ".join(_reached(r) for r in EXAMPLE_RULES))

# Reports over the stored day totals give what the usage rows themselves give.
for _name in ("functions_budget", "custom_budget_alert", "budget_tiers", "daily_spend", "top_spend_days"):
    ORACLE[f"day_rollup_{_name}"] = ORACLE[_name]
ORACLE["day_rollup_budget_alert"] = ORACLE["budget_alert_month"]
