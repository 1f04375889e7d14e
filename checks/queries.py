"""One named query per operator, over the whole bound test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.bindings import AS_OF, AS_OF_ORDERS, END, ORDERS_END, ORDERS_START, START, BoundTables
from checks.stored import STORED
from spendtrace.functions import exprs as X
from spendtrace.functions import sqltext as S
from spendtrace.operators import agent_costs as G
from spendtrace.operators import attribution as A
from spendtrace.operators import budgets as H
from spendtrace.operators import costs as C
from spendtrace.operators import latency as L
from spendtrace.operators import logs as D
from spendtrace.operators import usage as U
from spendtrace.schemas import RATE_CARDS, rate_card
from spendtrace.sources import catalog as K
from spendtrace.sources import extract as E
from spendtrace.sources.sinks import table_row_counts
from spendtrace.sources.tables import UsageTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BUILDERS: dict[str, tuple[Callable[[UsageTables], DataFrame], str]] = {}

MODELS = ["@db.models/model_2.yaml", "@db.models/model_3.yaml"]
AGENTS = ["agent_0", "agent_2", "agent_4"]
ALL_TIME = ("2023-01-01 00:00:00", "2025-01-01 00:00:00")


def query(name: str) -> Callable[..., None]:
    """Register a query. Dates are shown as ISO text so that any engine's result hashes alike."""

    def register(build: Callable[[UsageTables], DataFrame], style: str = "mixed") -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(BoundTables(spark, sf_dir, style))
            dates = {f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType == T.DateType()}
            decimals = {
                f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)
            }
            return df.withColumns({**dates, **decimals}) if dates or decimals else df

        QUERIES[name] = run
        BUILDERS[name] = (build, style)

    return register


def logs(t: UsageTables) -> DataFrame:
    return E.extract_request_log(t.request_log_raw)


def history(t: UsageTables) -> DataFrame:
    return A.query_history_cost(t.query_history, t.query_attribution, AS_OF)


def matched(t: UsageTables) -> A.Matched:
    """Requests matched by the cascade, whose tier is probed first."""
    sides = history(t), logs(t)
    return A.match_requests(*sides, known_tier=A.matching_tier(*sides))


def one_plan(t: UsageTables) -> A.Matched:
    """The same match with the choice of tier as a subquery of its plan."""
    return A.match_requests(history(t), logs(t))


def exact(t: UsageTables) -> A.Matched:
    return A.match_exact(history(t), logs(t))


def analyst(t: UsageTables) -> DataFrame:
    return E.analyst_latency_data(t.request_log_raw, START, END, newest_first=False)


def executions(t: UsageTables, marker: str = "Generated by Assistant") -> DataFrame:
    return E.sql_execution_data(t.query_history, START, END, marker, newest_first=False)


def latency_match(t: UsageTables) -> A.LatencyMatch:
    return A.match_latency(analyst(t), executions(t, ""))


def priced(t: UsageTables, rates: str = "SI") -> DataFrame:
    return G.filter_users(G.price_tokens(E.agent_events(t.agent_events_raw, 30, AS_OF), rates))


def query_costs(t: UsageTables) -> DataFrame:
    return G.agent_query_costs(E.agent_sql_queries(t.agent_events_raw, 30, AS_OF), t.query_history)


# --- extraction -------------------------------------------------------------

query("request_log_extract")(logs)
query("request_log_selected_models")(lambda t: E.extract_request_log(t.request_log_raw, MODELS))
query("request_log_recent_mid_month")(
    lambda t: E.recent_request_log(t.request_log_raw, "2024-01-10 12:00:00", 7)
)
query("request_log_recent")(lambda t: E.recent_request_log(t.request_log_raw, AS_OF, 14))
query("analyst_latency_data")(lambda t: E.analyst_latency_data(t.request_log_raw, START, END, MODELS[0]))
query("analyst_latency_data_all")(lambda t: E.analyst_latency_data(t.request_log_raw, START, END))
query("sql_execution_data")(lambda t: E.sql_execution_data(t.query_history, START, END))
query("agent_tool_models")(lambda t: K.agent_tool_models(t.agents))
query("agent_tool_models_with_file")(lambda t: K.agent_tool_models(t.agents, drop_null_files=True))
query("agent_catalog")(lambda t: K.agent_catalog(t.agents))
query("agent_events")(lambda t: E.agent_events(t.agent_events_raw, 20, AS_OF))
query("agent_events_selected")(lambda t: E.agent_events(t.agent_events_raw, 20, AS_OF, AGENTS))
query("agent_sql_queries")(lambda t: E.agent_sql_queries(t.agent_events_raw, 20, AS_OF))

# --- text and scalar functions ---------------------------------------------

query("clean_query_text")(
    lambda t: t.query_history.select("query_id", S.clean_query_text("query_text").alias("cleaned_query_text"))
)
query("normalize_sql")(
    lambda t: logs(t).select(
        "request_id",
        S.normalize_sql("generated_sql").alias("normalized_sql"),
        S.sql_fragment(S.normalize_sql("generated_sql"), 100).alias("fragment_100"),
        S.sql_fragment(S.normalize_sql("generated_sql"), 50).alias("fragment_50"),
    )
)
query("normalize_sql_repaired")(
    lambda t: logs(t).select(
        "request_id",
        S.normalize_sql("generated_sql", [("status\\s*=\\s*'active'", "state = 'on'"), ("region\\b", "area")]).alias(
            "normalized_sql"
        ),
    )
)
query("normalize_sql_latency")(
    lambda t: logs(t).select("request_id", S.normalize_sql_latency("generated_sql").alias("normalized_sql"))
)
query("period_starts")(
    lambda t: t.function_usage.select(X.day("start_time").alias("day")).distinct().select(
        "day",
        *[X.period_start(p, AS_OF).alias(f"{p.lower()}_start") for p in X.PERIODS],
    )
)
query("events_last_7_days")(
    lambda t: t.function_usage.filter(X.within("start_time", *X.last_days(7, AS_OF)))
    .groupBy(X.day("start_time").alias("day"))
    .agg(F.count("*").alias("rows"))
)
query("latency_seconds")(
    lambda t: logs(t).select(
        "request_id",
        X.ms_to_s("latency_ms").alias("seconds"),
        X.ms_to_s("latency_ms", 2).alias("seconds_rounded"),
        X.dbl(X.total_latency("latency_ms", F.lit(5))).alias("total_latency"),
        X.dbl(X.total_time("latency_ms", F.lit(5))).alias("total_time"),
    )
)

# --- joins ------------------------------------------------------------------

query("query_history_cost")(history)
query("query_history_cost_left")(
    lambda t: A.query_history_cost(
        t.query_history, t.query_attribution, AS_OF, text_patterns=["%from t_1_ %", "%c_7 %"], how="left"
    )
)
query("attribute_requests")(lambda t: matched(t).pairs())
query("attribute_requests_one_plan")(lambda t: one_plan(t).pairs())
query("attribute_requests_prefix_100")(lambda t: matched(t).pairs(), style="commented")
query("attribute_requests_prefix_50")(lambda t: matched(t).pairs(), style="reworded")
query("attribute_requests_two_tiers")(
    lambda t: A.attribute_requests(history(t), logs(t), (None, 100)), style="commented"
)
query("attribute_requests_no_match")(
    lambda t: A.attribute_requests(history(t), logs(t), (None, 100)), style="reworded"
)
query("attribute_requests_exact")(lambda t: A.attribute_requests(history(t), logs(t), normalize=False))
query("join_latency")(lambda t: latency_match(t).pairs())
query("join_latency_marked")(lambda t: A.join_latency(analyst(t), executions(t)))
query("functions_query_history")(
    lambda t: U.functions_query_history(t.function_query_usage, t.query_history, START, END)
)
query("agent_query_costs")(query_costs)
query("join_diagnostics")(lambda t: A.join_diagnostics(history(t), logs(t)))

# --- request log rollups ----------------------------------------------------

query("verified_query_count")(lambda t: D.verified_query_count(logs(t)))
query("top_verified_queries")(lambda t: D.top_verified_queries(logs(t), 3))
query("slowest_queries")(lambda t: D.slowest_queries(logs(t)))
query("latency_summary")(lambda t: D.latency_summary(logs(t)))
query("user_activity")(lambda t: D.user_activity(logs(t)))
query("model_usage_summary")(lambda t: D.model_usage_summary(logs(t)))
query("query_type_view")(lambda t: D.query_type_view(logs(t)))
query("daily_usage_by_model")(lambda t: D.daily_usage_by_model(logs(t)))
query("log_coverage")(lambda t: D.log_coverage(logs(t)))
query("query_type_share")(lambda t: D.query_type_share(logs(t)))
query("query_type_pivot")(lambda t: D.query_type_pivot(logs(t)))
query("table_row_counts")(
    lambda t: table_row_counts({"request_log": t.request_log_raw, "query_history_cost": history(t)})
)

# --- cost rollups -----------------------------------------------------------

query("total_cost_by_model")(lambda t: C.total_cost_by_model(matched(t)))
query("cost_breakdown_by_model")(lambda t: C.cost_breakdown_by_model(matched(t)))
query("cost_breakdown_prefix_100")(lambda t: C.cost_breakdown_by_model(matched(t)), style="commented")
query("cost_by_agent")(
    lambda t: C.cost_by_agent(K.agent_tool_models(t.agents), C.total_cost_by_model(matched(t)))
)
query("total_agent_cost")(
    lambda t: C.total_agent_cost(
        C.cost_by_agent(K.agent_tool_models(t.agents), C.total_cost_by_model(matched(t)))
    )
)
query("cost_summary_view")(lambda t: C.cost_summary_view(exact(t)))
query("cost_summary_view_sample")(lambda t: D.sample(C.cost_summary_view(exact(t)), 5))
query("user_activity_view")(lambda t: C.user_activity_view(exact(t)))
query("cost_by_user")(lambda t: C.cost_by_user(matched(t)))
query("attributed_total")(lambda t: C.attributed_total(matched(t)))
query("latency_describe")(
    lambda t: C.latency_describe(matched(t)).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )
)
query("mean_total_time")(lambda t: C.mean_total_time(matched(t)))
query("user_activity_joined")(lambda t: C.user_activity_joined(matched(t)))
query("daily_usage")(lambda t: C.daily_usage(matched(t)))
query("model_value_counts")(lambda t: C.model_value_counts(matched(t)))
query("agent_inventory")(lambda t: C.agent_inventory(K.agent_tool_models(t.agents)))

# --- usage rollups ----------------------------------------------------------

query("ai_services_total")(lambda t: U.ai_services_total(t.metering, ORDERS_START, ORDERS_END))
query("ai_services_total_days")(lambda t: U.ai_services_total_days(t.metering, AS_OF_ORDERS, 365))
query("llm_summary")(lambda t: U.llm_summary(t.function_usage, START, END))
query("llm_summary_all_functions")(lambda t: U.llm_summary(t.function_usage, START, END, None))
query("llm_summary_days")(lambda t: U.llm_summary_days(t.function_usage, AS_OF))
query("analyst_summary")(lambda t: U.analyst_summary(t.analyst_usage, START, END))
query("analyst_summary_days")(lambda t: U.analyst_summary_days(t.analyst_usage, AS_OF))
query("document_credits")(lambda t: U.document_credits(t.document_usage, START, END))
query("functions_total")(lambda t: U.functions_total(t.function_usage, START, END))
query("functions_total_empty_window")(lambda t: U.functions_total(t.function_usage, ORDERS_START, ORDERS_END))
query("credits_by_function")(lambda t: U.credits_by_function(t.function_usage, START, END))
query("credits_by_model")(lambda t: U.credits_by_model(t.function_usage, START, END, 5))
query("search_total")(lambda t: U.search_total(t.search_usage, START, END))
query("search_by_service")(lambda t: U.search_by_service(t.search_usage, START, END))
query("credits_by_warehouse")(
    lambda t: U.credits_by_warehouse(t.warehouse_metering, t.function_usage, START, END)
)
query("credits_by_warehouse_plain")(
    lambda t: U.credits_by_warehouse(t.warehouse_metering, t.function_usage, START, END, pre_aggregate=True)
)
query("analyst_by_day")(lambda t: U.analyst_by_day(t.analyst_usage, START, END))
query("document_metrics")(lambda t: U.document_metrics(t.document_usage, START, END))
query("document_by_day")(lambda t: U.document_by_day(t.document_usage, START, END))
query("search_by_day")(lambda t: U.search_by_day(t.search_usage, START, END))
query("service_overview")(lambda t: U.service_overview(t, START, END))
query("overview_headline")(lambda t: U.overview_headline(t, START, END))
query("daily_spend")(lambda t: U.daily_spend(t.metering, AS_OF_ORDERS))
query("top_spend_days")(lambda t: U.top_spend_days(t.metering, AS_OF_ORDERS))
query("run_history")(lambda t: U.run_history(t.scheduled_runs))

# --- latency report ---------------------------------------------------------

query("gen_breakdown")(lambda t: L.gen_breakdown(analyst(t)))
query("gen_headline")(lambda t: L.gen_headline(analyst(t)))
query("gen_headline_one_model")(lambda t: L.gen_headline(L.filter_models(analyst(t), MODELS[0])))
query("gen_series")(lambda t: L.gen_series(analyst(t)))
query("slowest_requests")(lambda t: L.slowest_requests(analyst(t)))
query("model_choices")(lambda t: L.model_choices(analyst(t)))
query("exec_headline")(lambda t: L.exec_headline(executions(t)))
query("exec_headline_filtered")(
    lambda t: L.exec_headline(L.filter_execs(executions(t), ["ai-agent"], ["WH_1", "WH_2"]))
)
query("exec_series")(lambda t: L.exec_series(executions(t)))
query("query_tag_distribution")(lambda t: L.query_tag_distribution(executions(t)))
query("warehouse_distribution")(lambda t: L.warehouse_distribution(executions(t)))
query("slowest_executions")(lambda t: L.slowest_executions(executions(t)))
query("exec_detail")(lambda t: L.exec_detail(executions(t)))
query("combined_headline")(lambda t: L.combined_headline(latency_match(t)))
query("latency_composition")(lambda t: L.latency_composition(latency_match(t)))
query("slowest_combined")(lambda t: L.slowest_combined(latency_match(t)))
query("combined_series")(lambda t: L.combined_series(latency_match(t).pairs()))

# --- agent costs ------------------------------------------------------------

query("price_tokens_si")(lambda t: priced(t, "SI"))
query("price_tokens_agent")(lambda t: priced(t, "Agent"))
query("user_choices")(lambda t: G.user_choices(E.agent_events(t.agent_events_raw, 30, AS_OF)))
query("agent_headline")(lambda t: G.agent_headline(priced(t), query_costs(t)))
query("token_breakdown")(lambda t: G.token_breakdown(priced(t)))
query("agent_combined")(lambda t: G.agent_combined(priced(t), query_costs(t)))
query("agent_query_summary")(lambda t: G.agent_query_summary(query_costs(t)))
query("agent_cost_by_user")(lambda t: G.agent_cost_by_user(priced(t)))
query("agent_cost_by_agent")(lambda t: G.agent_cost_by_agent(priced(t)))
query("agent_cost_daily")(lambda t: G.agent_cost_daily(priced(t)))
query("agent_cost_detail")(lambda t: G.agent_cost_detail(priced(t)))


def _models_by_rate(t: UsageTables) -> DataFrame:
    """Both rate cards next to the events they price."""
    used = E.agent_events(t.agent_events_raw, 30, AS_OF).groupBy("model_name").agg(F.count("*").alias("events"))
    cards = None
    for kind in RATE_CARDS:
        card = rate_card(t.spark, kind).select(F.lit(kind).alias("card"), "*")
        cards = card if cards is None else cards.unionByName(card)
    return cards.join(used, "model_name")


query("rate_cards")(_models_by_rate)

# --- budgets ----------------------------------------------------------------

query("budget_alert_month")(lambda t: H.budget_alert(t, "MONTH", 10, AS_OF))
query("budget_alert_week_two_services")(
    lambda t: H.budget_alert(t, "week", 500, AS_OF, documents=False, search=False)
)
query("budget_alert_day")(lambda t: H.budget_alert(t, "DAY", 0.01, AS_OF))
query("functions_budget_mid_month")(lambda t: H.functions_budget(t.function_usage, "DAY", 1, "2024-01-10"))
query("functions_budget")(lambda t: H.functions_budget(t.function_usage, "MONTH", 1000, AS_OF))
query("custom_budget_alert")(
    lambda t: H.custom_budget_alert(t.metering, "MONTH", 1000, "Acme Corporation", AS_OF_ORDERS)
)
query("custom_budget_alert_ok")(
    lambda t: H.custom_budget_alert(t.metering, "WEEK", 1e8, "Acme Corporation", AS_OF_ORDERS)
)
query("budget_tiers")(lambda t: H.budget_tiers(t, H.budget_rules(t.spark), AS_OF))

# --- tables and streams -----------------------------------------------------

for _name, _build in STORED.items():
    query(_name)(_build)
