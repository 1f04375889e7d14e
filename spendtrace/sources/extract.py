"""Typed frames out of raw request logs, query history and agent traces.

JSON bodies are parsed once per row into a variant and only when a column that
needs them is selected. One scan covers any number of models or agents.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.schemas import REQUEST_CREDITS, SQL_MARKER, VERIFIED_PATH, TraceKeys


def _text(variant: str, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _whole(variant: str, path: str) -> Column:
    """JSON number as a rounded whole number; text, junk and what no bigint holds (NaN too) is NULL."""
    return F.round(F.try_variant_get(variant, path, "double")).try_cast("bigint")


def _dotted(key: str) -> str:
    return f'$["{key}"]'


def _only(df: DataFrame, column: str, wanted: str | Sequence[str] | None) -> DataFrame:
    if wanted is None:
        return df
    return df.filter(F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted)))


def extract_request_log(
    raw: DataFrame,
    semantic_models: str | Sequence[str] | None = None,
    since: X.Moment | None = None,
    price: Decimal = REQUEST_CREDITS,
    verified_path: str = VERIFIED_PATH,
) -> DataFrame:
    """Processed request log: 17 columns, one row per raw request."""
    raw = _only(raw, "semantic_model_name", semantic_models)
    if since is not None:
        raw = raw.filter(F.col("timestamp") >= X.moment(since))
    bodies = raw.withColumns(
        {
            "_request": F.try_parse_json("request_body"),
            "_response": F.try_parse_json("response_body"),
        }
    )
    verified = "$.message.content[1].confidence.verified_query_used"
    return bodies.select(
        "timestamp",
        "request_id",
        "semantic_model_name",
        "tables_referenced",
        "user_name",
        "source",
        "feedback",
        "response_status_code",
        _text("_request", "$.messages[0].content[0].text").alias("user_question"),
        _whole("_response", "$.response_metadata.analyst_latency_ms").alias("latency_ms"),
        "generated_sql",
        _text("_response", "$.response_metadata.analyst_orchestration_path").alias("orchestration_path"),
        _text("_response", "$.response_metadata.question_category").alias("question_category"),
        _text("_response", f"{verified}.name").alias("verified_query_name"),
        _text("_response", f"{verified}.question").alias("verified_query_question"),
    ).select(
        "*",
        X.query_type("orchestration_path", verified_path).alias("query_type"),
        X.request_credits(price).alias("request_credits"),
    )


def recent_request_log(raw: DataFrame, as_of: X.Moment, days: int = 30, **options) -> DataFrame:
    """Request log over all models for the last ``days`` days."""
    return extract_request_log(raw.filter(X.up_to("timestamp", as_of)), since=X.days_before(as_of, days), **options)


def analyst_latency_data(
    raw: DataFrame,
    start: X.Moment,
    end: X.Moment,
    semantic_models: str | Sequence[str] | None = None,
    newest_first: bool = True,
) -> DataFrame:
    """Successful requests of a window with their generation latency."""
    rows = _only(raw, "semantic_model_name", semantic_models).filter(
        (F.col("response_status_code") == 200) & X.within("timestamp", start, end)
    )
    rows = rows.withColumns(
        {
            "_request": F.try_parse_json("request_body"),
            "_response": F.try_parse_json("response_body"),
        }
    ).select(
        "timestamp",
        "request_id",
        "semantic_model_name",
        "user_name",
        _whole("_response", "$.response_metadata.analyst_latency_ms").alias("analyst_latency_ms"),
        _text("_request", "$.messages[0].content[0].text").alias("user_question"),
        "generated_sql",
        "response_status_code",
    )
    return rows.orderBy(F.col("timestamp").desc_nulls_last()) if newest_first else rows


def sql_execution_data(
    query_history: DataFrame,
    start: X.Moment,
    end: X.Moment,
    marker: str = SQL_MARKER,
    newest_first: bool = True,
) -> DataFrame:
    """Successful executions of generated SQL, recognised by a marker comment."""
    rows = query_history.filter(
        X.within("start_time", start, end)
        & F.col("query_text").contains(marker)
        & (F.col("execution_status") == "SUCCESS")
    ).select(
        "query_id",
        "query_text",
        "query_tag",
        "start_time",
        "end_time",
        F.col("total_elapsed_time").alias("execution_time_ms"),
        "user_name",
        "warehouse_name",
        "execution_status",
    )
    return rows.orderBy(F.col("start_time").desc_nulls_last()) if newest_first else rows


def agent_events(
    raw: DataFrame,
    days_back: int,
    as_of: X.Moment,
    agents: Sequence[str] | None = None,
    keys: TraceKeys = TraceKeys(),
) -> DataFrame:
    """Agent traces with model and token counts; rows without tokens stay."""
    since = X.days_before(X.as_date(as_of), days_back)
    rows = raw.filter((F.col("timestamp") >= X.moment(since)) & X.up_to("timestamp", as_of)).withColumns(
        {
            "_resource": F.try_parse_json("resource_attributes"),
            "_attributes": F.try_parse_json("record_attributes"),
        }
    )
    rows = rows.select(
        F.col("timestamp").alias("event_time"),
        X.day("timestamp").alias("event_date"),
        _text("_resource", _dotted(keys.user)).alias("user_name"),
        _text("_attributes", _dotted(keys.agent)).alias("agent_name"),
        _text("_attributes", _dotted(keys.model)).alias("model_name"),
        _whole("_attributes", _dotted(f"{keys.tokens}.input")).alias("input_tokens"),
        _whole("_attributes", _dotted(f"{keys.tokens}.output")).alias("output_tokens"),
        _whole("_attributes", _dotted(f"{keys.tokens}.cache_creation")).alias("cache_write_tokens"),
        _whole("_attributes", _dotted(f"{keys.tokens}.cache_read")).alias("cache_read_tokens"),
        _whole("_attributes", _dotted(f"{keys.tokens}.total")).alias("total_tokens"),
    )
    return _only(rows, "agent_name", agents)


def agent_sql_queries(
    raw: DataFrame,
    days_back: int,
    as_of: X.Moment,
    agents: Sequence[str] | None = None,
    keys: TraceKeys = TraceKeys(),
) -> DataFrame:
    """Distinct (query, user, agent, date) of SQL-execution spans."""
    since = X.days_before(X.as_date(as_of), days_back)
    rows = raw.filter((F.col("timestamp") >= X.moment(since)) & X.up_to("timestamp", as_of)).withColumns(
        {
            "_resource": F.try_parse_json("resource_attributes"),
            "_attributes": F.try_parse_json("record_attributes"),
            "_record": F.try_parse_json("record"),
        }
    )
    rows = rows.filter(_text("_record", "$.name") == keys.sql_span).select(
        _text("_attributes", _dotted(keys.query_id)).alias("query_id"),
        _text("_resource", _dotted(keys.query_user)).alias("user_name"),
        _text("_attributes", _dotted(keys.agent)).alias("agent_name"),
        X.day("timestamp").alias("event_date"),
    )
    return _only(rows.filter(F.col("query_id").isNotNull()), "agent_name", agents).distinct()
