"""Relation schemas and the constants that define results."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Credits are summed as decimals so that totals do not depend on row order.
CREDITS = T.DecimalType(18, 9)

# Flat request price (67 credits per 1000 requests), the path
# that marks an answer from a curated query, and the two query-type labels.
REQUEST_CREDITS = Decimal("0.067")
VERIFIED_PATH = "vqr_fast_path"
VERIFIED = "Verified Query"
NON_VERIFIED = "Non-Verified Query"

# Log conventions that differ per installation. All are plain defaults of
# arguments, so another installation passes its own.
AGENT_TAG = "ai-agent"
SQL_MARKER = "Generated by Assistant"
AI_SERVICE_TYPE = "AI_SERVICES"
COMPLETION_FUNCTION = "COMPLETE"

# Credits per one million tokens (input, output, cache write, cache read).
RATE_CARDS = {
    "Agent": [
        ("claude-3-5-sonnet", "1.88", "9.41", "0.00", "0.00"),
        ("claude-3-7-sonnet", "1.88", "9.41", "2.35", "0.19"),
        ("claude-4-sonnet", "1.88", "9.41", "2.35", "0.19"),
        ("claude-haiku-4-54", "0.69", "3.45", "0.87", "0.07"),
        ("claude-4-5-sonnet", "2.07", "10.36", "2.59", "0.21"),
        ("openai-gpt-4.1", "1.38", "5.52", "0.00", "0.35"),
        ("openai-gpt-54", "0.86", "6.90", "0.00", "0.09"),
    ],
    "SI": [
        ("claude-3-5-sonnet", "2.51", "12.55", "0.00", "0.00"),
        ("claude-3-7-sonnet", "2.51", "12.55", "3.14", "0.25"),
        ("claude-4-sonnet", "2.51", "12.55", "3.14", "0.25"),
        ("claude-haiku-4-54", "0.92", "4.60", "1.15", "0.09"),
        ("claude-4-5-sonnet", "2.76", "13.81", "3.45", "0.28"),
        ("openai-gpt-4.1", "1.84", "7.36", "0.00", "0.46"),
        ("openai-gpt-54", "1.15", "9.21", "0.00", "0.12"),
    ],
}


@dataclass(frozen=True)
class TraceKeys:
    """Dotted attribute keys of agent observability events."""

    user: str = "user.name"
    query_user: str = "db.user"
    agent: str = "ai.observability.object.name"
    model: str = "ai.observability.agent.planning.model"
    tokens: str = "ai.observability.agent.planning.token_count"
    query_id: str = "ai.observability.agent.tool.sql_execution.query_id"
    sql_span: str = "SqlExecution"


REQUEST_LOG_RAW = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("semantic_model_name", T.StringType()),
        T.StructField("tables_referenced", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("response_status_code", T.IntegerType()),
        T.StructField("request_body", T.StringType()),
        T.StructField("response_body", T.StringType()),
        T.StructField("generated_sql", T.StringType()),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("semantic_model_name", T.StringType()),
        T.StructField("tables_referenced", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("response_status_code", T.IntegerType()),
        T.StructField("user_question", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("generated_sql", T.StringType()),
        T.StructField("orchestration_path", T.StringType()),
        T.StructField("question_category", T.StringType()),
        T.StructField("verified_query_name", T.StringType()),
        T.StructField("verified_query_question", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("request_credits", T.DoubleType()),
    ]
)

BUDGET_RULES = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("limit", T.DoubleType()),
        T.StructField("functions", T.BooleanType()),
        T.StructField("analyst", T.BooleanType()),
        T.StructField("documents", T.BooleanType()),
        T.StructField("search", T.BooleanType()),
    ]
)


def rate_card(spark: SparkSession, kind: str = "SI") -> DataFrame:
    """Built-in rate card: model_name and four credits-per-million rates.

    Inline values give the optimizer an exact size, so a join with the card is
    broadcast because it is known to be a few hundred bytes.
    """
    if kind not in RATE_CARDS:
        raise ValueError(f"unknown rate card {kind!r}; choose from {sorted(RATE_CARDS)}")
    rows = ", ".join(
        "('{}', {})".format(model, ", ".join(f"CAST({r} AS DECIMAL(9,4))" for r in rates))
        for model, *rates in RATE_CARDS[kind]
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS card(model_name, input_rate, output_rate, "
        "cache_write_rate, cache_read_rate)"
    )
