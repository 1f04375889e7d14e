"""Rollups of billed usage. Windows are inclusive; SQL rules for NULLs and rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.schemas import AI_SERVICE_TYPE, COMPLETION_FUNCTION
from spendtrace.sources.tables import UsageTables


def _window(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return usage.filter(X.within("start_time", start, end))


def _since(usage: DataFrame, days: int, as_of: X.Moment) -> DataFrame:
    return usage.filter((F.col("start_time") >= X.moment(X.days_before(as_of, days))) & X.up_to("start_time", as_of))


def _rounded(c: str, digits: int) -> Column:
    return X.half_up(X.sum_credits(c), digits)


# --- totals -----------------------------------------------------------------


def _ai_total(metering: DataFrame, service: str) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,9)")
    total = X.half_up(F.coalesce(X.sum_credits("credits_used"), zero), 2)
    return metering.filter(F.col("service_type") == service).agg(total.alias("total_credits"))


def ai_services_total(
    metering: DataFrame, start: X.Moment, end: X.Moment, service: str = AI_SERVICE_TYPE
) -> DataFrame:
    """AI service credits of a window; 0 when there are none."""
    return _ai_total(_window(metering, start, end), service)


def ai_services_total_days(
    metering: DataFrame, as_of: X.Moment, days: int = 30, service: str = AI_SERVICE_TYPE
) -> DataFrame:
    return _ai_total(_since(metering, days, as_of), service)


def llm_summary(
    usage: DataFrame, start: X.Moment, end: X.Moment, function: str | None = COMPLETION_FUNCTION
) -> DataFrame:
    """Credits (whole) and tokens of one function, or of all with ``function=None``."""
    rows = _window(usage, start, end)
    if function is not None:
        rows = rows.filter(F.col("function_name") == function)
    return rows.agg(
        _rounded("token_credits", 0).alias("llm_inference_credits"),
        F.sum("tokens").alias("llm_inference_tokens"),
    )


def llm_summary_days(
    usage: DataFrame, as_of: X.Moment, days: int = 7, function: str = COMPLETION_FUNCTION
) -> DataFrame:
    """Credits (2 digits) and input plus output tokens of the last days."""
    return (
        _since(usage, days, as_of)
        .filter(F.col("function_name") == function)
        .agg(
            _rounded("credits_used", 2).alias("llm_inference_credits"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("llm_inference_tokens"),
        )
    )


def analyst_summary(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    """Credits (whole) and requests of a window."""
    return _window(usage, start, end).agg(
        _rounded("credits", 0).alias("analyst_credits"),
        F.sum("request_count").alias("number_messages"),
    )


def analyst_summary_days(usage: DataFrame, as_of: X.Moment, days: int = 7) -> DataFrame:
    """Attributed credits (2 digits) and usage rows of the last days."""
    return _since(usage, days, as_of).agg(
        _rounded("credits_attributed", 2).alias("analyst_credits"),
        F.count("*").alias("number_messages"),
    )


def document_credits(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _window(usage, start, end).agg(_rounded("credits_used", 2).alias("total_credits"))


def functions_total(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _window(usage, start, end).agg(_rounded("token_credits", 2).alias("total_credits"))


def search_total(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _window(usage, start, end).agg(_rounded("credits", 2).alias("search_credits"))


def document_metrics(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _window(usage, start, end).agg(
        _rounded("credits_used", 2).alias("total_credits"),
        F.sum("page_count").alias("total_pages"),
        F.sum("document_count").alias("total_documents"),
    )


# --- breakdowns -------------------------------------------------------------


def credits_by_function(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return (
        _window(usage, start, end)
        .groupBy("function_name")
        .agg(_rounded("token_credits", 2).alias("total_credits"))
        .orderBy(F.desc_nulls_last("total_credits"), F.asc_nulls_last("function_name"))
    )


def credits_by_model(
    usage: DataFrame,
    start: X.Moment,
    end: X.Moment,
    limit: int = 10,
    function: str = COMPLETION_FUNCTION,
) -> DataFrame:
    """Top models of one function by credits."""
    return (
        _window(usage, start, end)
        .filter(F.col("function_name") == function)
        .groupBy("model_name")
        .agg(
            X.dbl(X.sum_credits("token_credits")).alias("total_credits_used"),
            F.sum("tokens").alias("total_tokens_used"),
        )
        .orderBy(F.desc_nulls_last("total_credits_used"), F.asc_nulls_last("model_name"))
        .limit(limit)
    )


def search_by_service(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return (
        _window(usage, start, end)
        .groupBy("service_name")
        .agg(X.dbl(X.sum_credits("credits")).alias("total_credits"))
        .orderBy(F.desc_nulls_last("total_credits"), F.asc_nulls_last("service_name"))
    )


def credits_by_warehouse(
    warehouse_metering: DataFrame,
    usage: DataFrame,
    start: X.Moment,
    end: X.Moment,
    pre_aggregate: bool = False,
) -> DataFrame:
    """Function credits and compute credits per warehouse.

    The default repeats each usage row per metering row of its warehouse and
    the other way round, as a join on the warehouse alone does; the repetition
    is computed from row counts. ``pre_aggregate=True`` gives plain totals.
    """
    used = (
        _window(usage, start, end)
        .groupBy("warehouse_id")
        .agg(X.sum_credits("token_credits").alias("_functions"), F.count("*").alias("_usage_rows"))
    )
    metered = warehouse_metering.groupBy("warehouse_name", "warehouse_id").agg(
        X.sum_credits("credits_used_compute").alias("_compute"), F.count("*").alias("_metering_rows")
    )
    repeat = lambda total, rows: X.dbl(
        F.col(total)
        if pre_aggregate
        else F.col(total).cast("decimal(24,9)") * F.col(rows).cast("decimal(12,0)")
    )
    return (
        metered.join(used, "warehouse_id")
        .select(
            "warehouse_name",
            "warehouse_id",
            repeat("_functions", "_metering_rows").alias("function_credits"),
            repeat("_compute", "_usage_rows").alias("compute_credits"),
        )
        .orderBy(F.desc_nulls_last("function_credits"), "warehouse_id")
    )


def functions_query_history(
    query_usage: DataFrame, query_history: DataFrame, start: X.Moment, end: X.Moment
) -> DataFrame:
    """Function usage with the query that caused it, by query start time."""
    queries = _window(query_history, start, end).select(
        "query_id", "query_text", "user_name", "role_name", "total_elapsed_time"
    )
    used = query_usage.select("query_id", "model_name", "function_name", "tokens", "token_credits")
    return used.join(queries, "query_id").select(
        "query_id",
        "model_name",
        "function_name",
        "tokens",
        "token_credits",
        "query_text",
        "user_name",
        "role_name",
        "total_elapsed_time",
    )


# --- by day -----------------------------------------------------------------


def _by_day(usage: DataFrame, start: X.Moment, end: X.Moment, *measures: Column) -> DataFrame:
    rows = _window(usage, start, end)
    return rows.groupBy(X.day("start_time").alias("day")).agg(*measures).orderBy("day")


def analyst_by_day(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _by_day(usage, start, end, F.sum("request_count").alias("total_request_count"))


def document_by_day(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _by_day(
        usage,
        start,
        end,
        _rounded("credits_used", 2).alias("daily_credits"),
        F.sum("page_count").alias("daily_pages"),
        F.sum("document_count").alias("daily_documents"),
    )


def search_by_day(usage: DataFrame, start: X.Moment, end: X.Moment) -> DataFrame:
    return _by_day(usage, start, end, _rounded("credits", 2).alias("daily_credits"))


def daily_spend(
    metering: DataFrame, as_of: X.Moment, services: Sequence[str] = (AI_SERVICE_TYPE,)
) -> DataFrame:
    """Credits per (service, day) since the start of the month, newest day first."""
    return (
        metering.filter(
            (F.col("start_time") >= X.period_start("MONTH", as_of).cast("timestamp_ntz"))
            & X.up_to("start_time", as_of)
            & F.col("service_type").isin(list(services))
        )
        .groupBy("service_type", X.day("start_time").alias("usage_date"))
        .agg(X.dbl(X.sum_credits("credits_used")).alias("daily_credits"))
        .orderBy(F.desc("usage_date"), F.desc_nulls_last("daily_credits"), "service_type")
    )


def top_spend_days(
    metering: DataFrame,
    as_of: X.Moment,
    n: int = 10,
    service: str = AI_SERVICE_TYPE,
    events: str | None = None,
) -> DataFrame:
    """Days of this month with the highest credits. ``events`` names how many events a row stands for, if not one."""
    return (
        metering.filter(
            (F.col("start_time") >= X.period_start("MONTH", as_of).cast("timestamp_ntz"))
            & X.up_to("start_time", as_of)
            & (F.col("service_type") == service)
        )
        .groupBy(X.day("start_time").alias("usage_date"))
        .agg(
            X.dbl(X.sum_credits("credits_used")).alias("total_credits"),
            (F.sum(events) if events else F.count("*")).alias("usage_events"),
        )
        .orderBy(F.desc_nulls_last("total_credits"), "usage_date")
        .limit(n)
    )


def run_history(runs: DataFrame, pattern: str = "%AI%MONITOR%", n: int = 20) -> DataFrame:
    """Newest scheduled runs whose name matches a LIKE pattern."""
    return (
        runs.filter(F.col("name").like(pattern))
        .select(
            "name",
            "state",
            "scheduled_time",
            "query_start_time",
            "completed_time",
            "return_value",
            "error_code",
            "error_message",
        )
        .orderBy(F.desc_nulls_last("scheduled_time"), "name")
        .limit(n)
    )


# --- all services -----------------------------------------------------------

# service -> (relation, credit column, digits in the overview)
SERVICES = {
    "functions": ("function_usage", "token_credits", 2),
    "analyst": ("analyst_usage", "credits", 0),
    "documents": ("document_usage", "credits_used", 2),
    "search": ("search_usage", "credits", 2),
}


def service_usage(tables: UsageTables, services: Sequence[str] = tuple(SERVICES)) -> DataFrame:
    """(service, start_time, credits) rows of the chosen services, one scan per table."""
    parts = []
    for service in services:
        relation, column, _ = SERVICES[service]
        parts.append(
            tables.get(relation).select(
                F.lit(service).alias("service"), "start_time", X.credits(column).alias("credits")
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def sum_of_service(service: str) -> Column:
    """Credits of one service within an aggregate over :func:`service_usage`."""
    return F.sum(F.when(F.col("service") == service, F.col("credits")))


def service_overview(
    tables: UsageTables, start: X.Moment, end: X.Moment, nonzero_only: bool = True
) -> DataFrame:
    """Credits per service, NULL as 0; the distribution keeps services above 0."""
    sums = _window(service_usage(tables), start, end).agg(
        *[
            F.coalesce(X.half_up(sum_of_service(s), digits), F.lit(0.0)).alias(s)
            for s, (_, _, digits) in SERVICES.items()
        ]
    )
    rows = sums.unpivot([], list(SERVICES), "service", "credits")
    return rows.filter(F.col("credits") > 0) if nonzero_only else rows


def overview_headline(tables: UsageTables, start: X.Moment, end: X.Moment) -> DataFrame:
    """One row: total AI service credits, completion credits and tokens, analyst messages."""
    parts = [
        ai_services_total(tables.metering, start, end).withColumnRenamed("total_credits", "total_ai_credits"),
        llm_summary(tables.function_usage, start, end),
        analyst_summary(tables.analyst_usage, start, end).select("number_messages"),
    ]
    names = [c for part in parts for c in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
