"""The latency report as a set of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spendtrace.functions import exprs as X
from spendtrace.operators import latency as L
from spendtrace.schemas import SQL_MARKER
from spendtrace.sources.extract import analyst_latency_data, sql_execution_data


def latency_report(analyst: DataFrame, executions: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Lazy report tables; both inputs are filtered by the caller, once for all tables."""
    return {
        "generation_headline": L.gen_headline(analyst),
        "generation_by_model": L.gen_breakdown(analyst),
        "slowest_requests": L.slowest_requests(analyst, n),
        "execution_headline": L.exec_headline(executions),
        "query_tags": L.query_tag_distribution(executions),
        "warehouses": L.warehouse_distribution(executions),
        "slowest_executions": L.slowest_executions(executions, n, with_text=False),
    }


def write_latency_report(
    request_log_raw: DataFrame,
    query_history: DataFrame,
    start: X.Moment,
    end: X.Moment,
    path: str,
    semantic_models: str | Sequence[str] | None = None,
    marker: str = SQL_MARKER,
    n: int = 10,
) -> dict[str, str]:
    """Write the report under ``path``; returns table name -> location.

    The two extracts are stored first and every table reads the stored copy.
    """
    spark = request_log_raw.sparkSession
    extracts = {
        "requests": analyst_latency_data(request_log_raw, start, end, semantic_models, newest_first=False),
        "executions": sql_execution_data(query_history, start, end, marker, newest_first=False),
    }
    locations = {}
    for name, df in extracts.items():
        locations[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(locations[name])
    stored = {name: spark.read.parquet(where) for name, where in locations.items()}
    for name, df in latency_report(stored["requests"], stored["executions"], n).items():
        locations[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(locations[name])
    return locations
