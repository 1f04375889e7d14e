"""End-to-end cost attribution: raw logs and history in, saved tables and reports out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spendtrace.functions import exprs as X
from spendtrace.operators import attribution as A
from spendtrace.operators import costs as C
from spendtrace.sources.catalog import agent_tool_models
from spendtrace.sources.extract import recent_request_log
from spendtrace.sources.tables import UsageTables

NOTEBOOK_TIERS = (None, 100)


def attribution_reports(
    history: DataFrame,
    logs: DataFrame,
    tool_models: DataFrame,
    tiers=NOTEBOOK_TIERS,
    repairs: Sequence[tuple[str, str]] = (),
    known_tier: int | None = None,
) -> dict[str, DataFrame]:
    """Lazy reports over one match of requests and executions."""
    matched = A.match_requests(history, logs, tiers, repairs, known_tier)
    by_model = C.total_cost_by_model(matched)
    by_agent = C.cost_by_agent(tool_models, by_model)
    return {
        "cost_by_model": by_model,
        "cost_breakdown": C.cost_breakdown_by_model(matched),
        "cost_by_agent": by_agent,
        "total_agent_cost": C.total_agent_cost(by_agent),
        "cost_by_user": C.cost_by_user(matched),
        "daily_usage": C.daily_usage(matched),
        "join_diagnostics": A.join_diagnostics(history, logs, repairs),
    }


def run_attribution(
    tables: UsageTables,
    as_of: X.Moment,
    path: str,
    days: int = 30,
    tiers=NOTEBOOK_TIERS,
    repairs: Sequence[tuple[str, str]] = (),
    **selection,
) -> dict[str, DataFrame]:
    """Write request log, query history and all reports under ``path``.

    Both inputs are written once, with their match keys, and read back: JSON
    parsing, text normalising and the history join run a single time, the
    tier of the match is chosen once, the reports do not read SQL texts, and a
    lost executor costs only a re-read.
    """
    selection = {"how": "left", **selection}
    history = A.query_history_cost(tables.query_history, tables.query_attribution, as_of, days, **selection)
    saved = {
        "request_log": A.with_match_keys(
            recent_request_log(tables.request_log_raw, as_of, days), "generated_sql", tiers, repairs
        ),
        "query_history_cost": A.with_match_keys(history, "cleaned_query_text", tiers, repairs),
        "agent_tool_models": agent_tool_models(tables.agents),
    }
    stored = {name: _write(df, f"{path}/{name}") for name, df in saved.items()}
    sides = stored["query_history_cost"], stored["request_log"]
    tier = A.matching_tier(*sides, tiers, repairs)
    reports = attribution_reports(*sides, stored["agent_tool_models"], tiers, repairs, tier)
    return {**stored, **{name: _write(df, f"{path}/{name}") for name, df in reports.items()}}


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
