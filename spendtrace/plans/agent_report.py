"""Agent cost report: traces priced by a rate card, with the cost of the SQL they ran."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spendtrace.functions import exprs as X
from spendtrace.operators import agent_costs as G
from spendtrace.schemas import TraceKeys
from spendtrace.sources.extract import agent_events, agent_sql_queries


def agent_report(
    agent_events_raw: DataFrame,
    query_history: DataFrame,
    as_of: X.Moment,
    days_back: int = 30,
    agents: Sequence[str] | None = None,
    users: Sequence[str] | None = None,
    rates: str | DataFrame = "SI",
    keys: TraceKeys = TraceKeys(),
) -> dict[str, DataFrame]:
    """Lazy report tables. The user choice applies to tokens, not to query credits."""
    priced = G.price_tokens(agent_events(agent_events_raw, days_back, as_of, agents, keys), rates)
    chosen = G.filter_users(priced, users)
    queries = G.agent_query_costs(
        agent_sql_queries(agent_events_raw, days_back, as_of, agents, keys), query_history
    )
    return {
        "headline": G.agent_headline(chosen, queries),
        "token_breakdown": G.token_breakdown(chosen),
        "by_agent_combined": G.agent_combined(chosen, queries),
        "query_summary": G.agent_query_summary(queries),
        "by_user": G.agent_cost_by_user(chosen),
        "by_agent": G.agent_cost_by_agent(chosen),
        "daily": G.agent_cost_daily(chosen),
        "detail": G.agent_cost_detail(chosen),
    }
