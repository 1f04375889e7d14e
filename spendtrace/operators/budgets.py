"""Budget checks: period-to-date credits against limits. ``message`` carries the alert text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators.usage import SERVICES, service_usage, sum_of_service
from spendtrace.schemas import AI_SERVICE_TYPE, BUDGET_RULES
from spendtrace.sources.tables import UsageTables


def _number(c: Column | str) -> Column:
    return F.format_string("%.2f", X.dbl(c))


def _opening(title: str, label: str, period: Column, start: Column, limit: Column, used: Column) -> list[Column]:
    return [
        F.lit(title),
        *([F.lit(f"Account: {label}")] if label else []),
        F.concat(F.lit("Period: "), period, F.lit(" (since "), start.cast("string"), F.lit(")")),
        F.concat(F.lit("Alert threshold: "), _number(limit), F.lit(" credits")),
        F.concat(F.lit("Current usage: "), _number(used), F.lit(" credits")),
    ]


def _in_period(start: Column, as_of: X.Moment) -> Column:
    """From the first day of a period up to ``as_of``."""
    return (F.col("start_time") >= start.cast("timestamp_ntz")) & X.up_to("start_time", as_of)


def budget_alert(
    tables: UsageTables,
    period: str,
    limit: float,
    as_of: X.Moment,
    functions: bool = True,
    analyst: bool = True,
    documents: bool = True,
    search: bool = True,
    label: str = "",
) -> DataFrame:
    """One row: credits per service since the period began, total, whether the limit is reached.

    Services switched off are not scanned and count as 0.
    """
    toggles = {"functions": functions, "analyst": analyst, "documents": documents, "search": search}
    chosen = [s for s in SERVICES if toggles[s]]
    start = X.period_start(period, as_of)
    zero = F.lit(0).cast("decimal(28,9)")
    if chosen:
        usage = service_usage(tables, chosen).filter(_in_period(start, as_of))
        sums = usage.agg(*[F.coalesce(sum_of_service(s), zero).alias(f"_{s}") for s in chosen])
    else:
        sums = tables.spark.range(1)
    amount = {s: F.col(f"_{s}") if s in chosen else zero for s in SERVICES}
    total = sum((amount[s] for s in chosen), zero)
    limit_col = F.lit(float(limit))
    reached = X.dbl(total) >= limit_col
    lines = _opening("AI services budget alert", label, F.lit(period.upper()), start, limit_col, total)
    breakdown = [F.concat(F.lit(f"{s}: "), _number(amount[s]), F.lit(" credits")) for s in chosen]
    verdict = F.when(reached, F.lit("ALERT: usage has reached the threshold")).otherwise(
        F.lit("Usage is within budget limits")
    )
    return sums.select(
        F.lit(period.upper()).alias("period"),
        start.alias("period_start"),
        limit_col.alias("limit"),
        *[X.dbl(amount[s]).alias(f"{s}_credits") for s in SERVICES],
        X.dbl(total).alias("total_credits"),
        reached.alias("triggered"),
        F.concat_ws("\n", *lines, F.lit("Service breakdown:"), *breakdown, verdict).alias("message"),
    )


def functions_budget(
    usage: DataFrame, period: str, limit: float, as_of: X.Moment, label: str = ""
) -> DataFrame:
    """One row for function credits only; the usage line is there whether or not the limit is reached."""
    start = X.period_start(period, as_of)
    used = F.coalesce(X.sum_credits("token_credits"), F.lit(0).cast("decimal(28,9)"))
    sums = usage.filter(_in_period(start, as_of)).agg(used.alias("_used"))
    account = f"Account: {label} - " if label else ""
    text = F.concat(
        F.lit(f"{account}function credit usage in this {period.upper()} = "), _number("_used")
    )
    return sums.select(
        F.lit(period.upper()).alias("period"),
        start.alias("period_start"),
        F.lit(float(limit)).alias("limit"),
        X.dbl("_used").alias("current_usage_credits"),
        (X.dbl("_used") >= F.lit(float(limit))).alias("triggered"),
        text.alias("message"),
    )


def custom_budget_alert(
    metering: DataFrame,
    period: str,
    limit: float,
    org: str,
    as_of: X.Moment,
    service: str = AI_SERVICE_TYPE,
) -> DataFrame:
    """One row: metered AI credits, percent of the limit and a three-level status."""
    start = X.period_start(period, as_of)
    used = F.coalesce(X.sum_credits("credits_used"), F.lit(0).cast("decimal(28,9)"))
    sums = metering.filter(
        _in_period(start, as_of) & (F.col("service_type") == service)
    ).agg(used.alias("_used"))
    limit_col = F.lit(float(limit))
    percent = X.half_up(
        F.try_divide(F.col("_used").cast("decimal(24,9)") * F.lit(100), F.lit(str(limit)).cast("decimal(24,9)")), 2
    )
    status = X.budget_status("_used", limit_col)
    closing = (
        F.when(status == "EXCEEDED", F.lit("Budget exceeded: act now"))
        .when(status == "WARNING", F.lit("Warning: 80% of the budget is used"))
        .otherwise(F.lit("Budget usage is within normal limits"))
    )
    share = F.concat(F.lit("Usage percentage: "), _number(percent), F.lit("%"))
    lines = _opening(f"{org} AI services budget report", "", F.lit(period.upper()), start, limit_col, F.col("_used"))
    return sums.select(
        F.lit(org).alias("organization"),
        F.lit(period.upper()).alias("period"),
        start.alias("period_start"),
        limit_col.alias("limit"),
        X.dbl("_used").alias("total_credits"),
        percent.alias("percentage_used"),
        status.alias("status"),
        F.concat_ws("\n", *lines, share, closing).alias("message"),
    )


# The call configurations and tiers that come with the budget cookbook
# (rule, period, limit, functions, analyst, documents, search).
EXAMPLE_RULES = [
    ("low_threshold_check", "MONTH", 10.0, True, True, True, True),
    ("weekly_functions_analyst", "WEEK", 500.0, True, True, False, False),
    ("daily_high_usage", "DAY", 100.0, True, True, True, True),
    ("functions_monthly", "MONTH", 1000.0, True, False, False, False),
    ("production", "MONTH", 5000.0, True, True, True, True),
    ("business_hours", "DAY", 1000.0, True, True, True, True),
    ("weekly_summary", "WEEK", 2000.0, True, True, True, True),
    ("monthly_review", "MONTH", 10000.0, True, True, True, True),
    ("tier_warning", "MONTH", 2500.0, True, True, True, True),
    ("tier_critical", "MONTH", 4000.0, True, True, True, True),
    ("functions_service", "MONTH", 3000.0, True, False, False, False),
    ("documents_service", "WEEK", 1000.0, False, False, True, False),
    ("hourly_monitor", "MONTH", 1000.0, True, True, True, True),
    ("daily_summary", "DAY", 500.0, True, True, True, True),
    ("smoke_test", "DAY", 0.01, True, True, True, True),
]


def budget_rules(spark: SparkSession, rules: Sequence[tuple] = EXAMPLE_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), BUDGET_RULES)


def rules_against_daily(rules: DataFrame, daily: DataFrame, as_of: X.Moment) -> DataFrame:
    """All rules against (service, day, credits) totals in one job.

    ``daily`` holds at most a month of days per service, whatever the number of
    usage rows behind it. Rules without usage get 0.
    """
    rules = rules.withColumn("period", F.upper("period")).withColumn(
        "period_start", X.period_start(F.col("period"), as_of)
    )
    watched = F.filter(
        F.array(*[F.when(F.col(s), F.lit(s)) for s in SERVICES]), lambda s: s.isNotNull()
    )
    by_service = rules.select("*", F.explode_outer(watched).alias("service"))
    used = by_service.join(
        daily.withColumnRenamed("service", "_service"),
        (F.col("service") == F.col("_service")) & (F.col("day") >= F.col("period_start")),
        "left",
    )
    zero = F.lit(0).cast("decimal(28,9)")
    return (
        used.groupBy("rule", "period", "period_start", "limit")
        .agg(F.coalesce(F.sum("credits"), zero).alias("_used"))
        .select(
            "rule",
            "period",
            "period_start",
            "limit",
            X.dbl("_used").alias("total_credits"),
            (X.dbl("_used") >= F.col("limit")).alias("triggered"),
            X.budget_status("_used", "limit").alias("status"),
            F.concat(
                F.col("rule"), F.lit(": "), _number("_used"), F.lit(" of "), _number("limit"), F.lit(" credits")
            ).alias("message"),
        )
        .orderBy("rule")
    )


def daily_totals(usage: DataFrame) -> DataFrame:
    """(service, day, credits) of :func:`service_usage` rows."""
    return usage.groupBy("service", X.day("start_time").alias("day")).agg(F.sum("credits").alias("credits"))


def budget_tiers(tables: UsageTables, rules: DataFrame, as_of: X.Moment) -> DataFrame:
    """Check every rule of a rules frame over one shared scan of usage."""
    earliest = F.least(X.period_start("WEEK", as_of), X.period_start("MONTH", as_of))
    usage = service_usage(tables).filter(_in_period(earliest, as_of))
    return rules_against_daily(rules, daily_totals(usage), as_of)
