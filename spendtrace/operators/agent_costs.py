"""Token pricing and agent cost reports. Dataframe rules: NULL group keys are dropped."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.schemas import CREDITS, rate_card

KINDS = ("input", "output", "cache_write", "cache_read")


def price_tokens(events: DataFrame, rates: str | DataFrame = "SI") -> DataFrame:
    """Credits per token kind and in total; unknown models and NULL tokens cost 0.

    ``rates`` names a built-in card or is a frame shaped like one. The built-in
    card has a known tiny size; a frame is joined by whatever its size allows, and a
    model that it lists more than once counts once, at its highest rate of each kind.
    """
    if isinstance(rates, str):
        card = rate_card(events.sparkSession, rates)
    else:
        card = rates.groupBy("model_name").agg(*[F.max(f"{kind}_rate").alias(f"{kind}_rate") for kind in KINDS])
    zero, per_token = F.lit(Decimal(0)), F.lit(Decimal("0.000001"))

    def cost(kind: str) -> Column:
        tokens = F.coalesce(F.col(f"{kind}_tokens"), F.lit(0)).cast("decimal(18,0)")
        rate = F.coalesce(F.col(f"{kind}_rate"), zero).cast("decimal(9,4)")
        return (tokens * rate * per_token).cast(CREDITS).alias(f"{kind}_credits")

    priced = events.join(card, "model_name", "left").select(
        *events.columns, *[cost(kind) for kind in KINDS]
    )
    total = sum((F.col(f"{kind}_credits") for kind in KINDS[1:]), F.col(f"{KINDS[0]}_credits"))
    return priced.withColumn("token_credits", total.cast(CREDITS))


def agent_query_costs(queries: DataFrame, query_history: DataFrame) -> DataFrame:
    """Agent queries with their cloud credits, seconds and warehouse, where known."""
    history = query_history.select(
        "query_id",
        F.col("credits_used_cloud_services").alias("query_credits"),
        X.ms_to_s("total_elapsed_time").alias("elapsed_seconds"),
        "warehouse_name",
        "warehouse_size",
    )
    return queries.join(history, "query_id", "left")


def user_choices(events: DataFrame) -> DataFrame:
    return events.select("user_name").dropna().distinct()


def filter_users(events: DataFrame, users: Sequence[str] | None = None) -> DataFrame:
    """Keep chosen users; without a choice all known users. Rows without user drop."""
    if users is None:
        return events.filter(F.col("user_name").isNotNull())
    return events.filter(F.col("user_name").isin(list(users)))


def agent_headline(priced: DataFrame, query_costs: DataFrame) -> DataFrame:
    """One row: total, token and query credits, distinct agents."""
    tokens = priced.agg(
        F.sum("token_credits").alias("token"), F.count_distinct("agent_name").alias("unique_agents")
    )
    queries = query_costs.agg(X.sum_credits("query_credits").alias("query"))
    both = tokens.unionByName(queries, allowMissingColumns=True).agg(
        F.coalesce(F.max("token"), F.lit(0)).alias("token"),
        F.coalesce(F.max("query"), F.lit(0)).alias("query"),
        F.max("unique_agents").alias("unique_agents"),
    )
    return both.select(
        X.dbl(F.col("token") + F.col("query")).alias("total_credits"),
        X.dbl("token").alias("token_credits"),
        X.dbl("query").alias("query_credits"),
        "unique_agents",
    )


def token_breakdown(priced: DataFrame) -> DataFrame:
    """Four rows: token kind and its credits."""
    sums = priced.agg(
        *[X.dbl(F.coalesce(F.sum(f"{kind}_credits"), F.lit(0))).alias(kind) for kind in KINDS]
    )
    return sums.unpivot([], list(KINDS), "kind", "credits")


def agent_combined(priced: DataFrame, query_costs: DataFrame) -> DataFrame:
    """Token plus query credits per agent; agents with query credits only are left out."""
    by_agent = lambda df, c: df.filter(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(c)
    tokens = by_agent(priced, F.sum("token_credits").alias("_token"))
    queries = by_agent(query_costs, X.sum_credits("query_credits").alias("_query"))
    query = F.coalesce("_query", F.lit(0))
    return (
        tokens.join(queries, "agent_name", "left")
        .select(
            "agent_name",
            X.dbl("_token").alias("token_credits"),
            X.dbl(query).alias("query_credits"),
            X.dbl(F.col("_token") + query).alias("total_credits"),
        )
        .orderBy(F.desc("total_credits"), "agent_name")
    )


def agent_query_summary(query_costs: DataFrame) -> DataFrame:
    """Queries, credits and seconds per agent."""
    return (
        query_costs.filter(F.col("agent_name").isNotNull())
        .groupBy("agent_name")
        .agg(
            F.count("query_id").alias("query_count"),
            X.dbl(F.coalesce(X.sum_credits("query_credits"), F.lit(0))).alias("total_query_credits"),
            X.dbl(F.coalesce(X.sum_credits("elapsed_seconds"), F.lit(0))).alias("total_elapsed_seconds"),
        )
        .orderBy("agent_name")
    )


def _token_sums() -> list[Column]:
    zero = F.lit(0)
    return [
        X.dbl(F.sum("token_credits")).alias("token_credits"),
        F.coalesce(F.sum("input_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
    ]


def agent_cost_by_user(priced: DataFrame) -> DataFrame:
    return (
        priced.filter(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(*_token_sums(), F.count("agent_name").alias("request_count"))
        .orderBy(F.desc("token_credits"), "user_name")
    )


def _with_first_model(priced: DataFrame, keys: list[str], *extra_keys: str) -> DataFrame:
    """Sums per (keys, model, extra keys) with the model's first use.

    This step hash-aggregates on the map side; what is left per group is a few
    rows, from which :func:`_first_model` takes the model seen first.
    """
    return (
        priced.dropna(subset=keys)
        .groupBy(*keys, "model_name", *extra_keys)
        .agg(
            F.sum("token_credits").alias("token_credits"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.min("event_time").alias("first_use"),
        )
    )


def _first_model() -> Column:
    known = F.when(F.col("model_name").isNotNull(), F.struct("first_use", "model_name"))
    return F.min(known)["model_name"].alias("model_name")


def agent_cost_by_agent(priced: DataFrame) -> DataFrame:
    """Credits, tokens, users and first model per agent."""
    return (
        _with_first_model(priced, ["agent_name"], "user_name")
        .groupBy("agent_name")
        .agg(*_token_sums(), F.count_distinct("user_name").alias("unique_users"), _first_model())
        .orderBy(F.desc("token_credits"), "agent_name")
    )


def agent_cost_daily(priced: DataFrame) -> DataFrame:
    """Credits and requests of known users per day."""
    return (
        priced.filter(F.col("event_date").isNotNull())
        .groupBy("event_date")
        .agg(
            X.dbl(F.sum("token_credits")).alias("token_credits"),
            X.dbl(F.sum("input_credits")).alias("input_credits"),
            X.dbl(F.sum("output_credits")).alias("output_credits"),
            F.count("user_name").alias("request_count"),
        )
        .orderBy("event_date")
    )


def agent_cost_detail(priced: DataFrame) -> DataFrame:
    """Credits, tokens and first model per (user, agent, date), newest and dearest first."""
    keys = ["user_name", "agent_name", "event_date"]
    return (
        _with_first_model(priced, keys)
        .groupBy(*keys)
        .agg(*_token_sums(), _first_model())
        .orderBy(F.desc("event_date"), F.desc("token_credits"), "user_name", "agent_name")
    )
