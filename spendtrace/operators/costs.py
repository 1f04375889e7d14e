"""Cost rollups over matched requests and executions.

Each function takes a :class:`Matched` (no pairs are formed) or a saved frame of
pairs. Repeated matches are not corrected: a request matched by three
executions is charged three times, as in the row-level result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators.attribution import Matched, pair_sums
from spendtrace.operators.stats import exact_stats, value_counts

MODEL = "semantic_model_name"
Pairs = Matched | DataFrame


def total_cost_by_model(matched: Pairs) -> DataFrame:
    """Combined credits per model, 4 digits. Dataframe rules."""
    sums = pair_sums(matched, MODEL).filter(F.col(MODEL).isNotNull())
    return sums.select(MODEL, X.half_even("total_credits", 4).alias("total_credits")).orderBy(
        F.desc("total_credits"), MODEL
    )


def cost_breakdown_by_model(matched: Pairs) -> DataFrame:
    """Request, warehouse and total credits per model; shares and averages of the rounded totals."""
    sums = pair_sums(matched, MODEL).filter(F.col(MODEL).isNotNull())
    rounded = sums.select(
        MODEL,
        X.half_even("request_credits", 4).alias("request_credits"),
        X.half_even("warehouse_credits", 4).alias("warehouse_credits"),
        X.half_even("total_credits", 4).alias("total_credits"),
        F.col("request_ids").alias("query_count"),
    )
    # One row per model is left, so the unpartitioned window is small. Summing
    # decimals keeps the total independent of row order.
    overall = F.sum(F.col("total_credits").cast("decimal(20,4)")).over(Window.partitionBy())
    return rounded.select(
        "*",
        X.half_even(X.divide("total_credits", overall) * F.lit(100.0), 2).alias("percentage_of_total_cost"),
        X.half_even(X.divide("total_credits", "query_count"), 4).alias("avg_credits_per_query"),
    ).orderBy(F.desc("total_credits"), MODEL)


def cost_by_agent(tool_models: DataFrame, model_costs: DataFrame) -> DataFrame:
    """Credits and tools per agent. A model shared by agents is charged to each of them."""
    costs = model_costs.select(F.col(MODEL).alias("semantic_model_file"), "total_credits")
    return (
        tool_models.join(costs, "semantic_model_file")
        .filter(F.col("agent_name").isNotNull())
        .groupBy("agent_name")
        .agg(
            X.half_even(X.sum_totals("total_credits"), 4).alias("total_credits"),
            F.count("tool_name").alias("tool_count"),
        )
        .orderBy(F.desc("total_credits"), "agent_name")
    )


def cost_summary_view(matched: Pairs) -> DataFrame:
    """Full cost summary per model, NULL model kept. SQL rules."""
    by_user = pair_sums(matched, MODEL, "user_name")
    sums = by_user.groupBy(MODEL).agg(
        F.sum("pairs").alias("query_count"),
        F.count_distinct("user_name").alias("unique_users"),
        F.sum("request_credits").alias("_request"),
        F.sum("warehouse_credits").alias("_warehouse"),
        F.sum("total_credits").alias("_total"),
        F.sum("latency_sum").alias("_latency"),
        F.sum("latency_count").alias("_timed"),
    )
    overall = F.sum("_total").over(Window.partitionBy())  # one row per model
    return sums.select(
        MODEL,
        "query_count",
        "unique_users",
        X.dbl("_request").alias("total_request_credits"),
        X.dbl("_warehouse").alias("total_warehouse_credits"),
        X.dbl("_total").alias("total_combined_credits"),
        X.half_up(X.decimal_divide("_latency", "_timed"), 2).alias("avg_latency_ms"),
        X.half_up(X.decimal_divide("_total", "query_count"), 4).alias("avg_credits_per_query"),
        X.percent_half_up("_total", overall).alias("percentage_of_total_cost"),
    ).orderBy(F.desc_nulls_last("total_combined_credits"), F.asc_nulls_last(MODEL))


def user_activity_view(matched: Pairs) -> DataFrame:
    """Pairs, mean latency, credits per (user, model) and share of the user. SQL rules."""
    sums = pair_sums(matched, "user_name", MODEL)
    of_user = F.sum("pairs").over(Window.partitionBy("user_name"))  # one row per model of a user
    return sums.select(
        "user_name",
        MODEL,
        F.col("pairs").alias("queries_count"),
        X.half_up(X.decimal_divide("latency_sum", "latency_count"), 2).alias("avg_latency_ms"),
        X.dbl("total_credits").alias("total_credits"),
        X.percent_half_up("pairs", of_user).alias("percentage_of_user_queries"),
    ).orderBy(F.asc_nulls_last("user_name"), F.desc("queries_count"), F.asc_nulls_last(MODEL))


def cost_by_user(matched: Pairs) -> DataFrame:
    """Compute credits and combined credits per requesting user."""
    sums = pair_sums(matched, "user_name").filter(F.col("user_name").isNotNull())
    return sums.select(
        "user_name",
        X.dbl("warehouse_credits").alias("credits_attributed_compute"),
        X.dbl("total_credits").alias("total_credits"),
    ).orderBy("user_name")


def attributed_total(matched: Pairs) -> DataFrame:
    """One row: all attributed compute credits, 4 digits."""
    return pair_sums(matched).select(X.half_even("warehouse_credits", 4).alias("total_credits_attributed_compute"))


def user_activity_joined(matched: Pairs) -> DataFrame:
    """Queries, mean latency and compute credits per requesting user."""
    sums = pair_sums(matched, "user_name").filter(F.col("user_name").isNotNull())
    return sums.select(
        "user_name",
        F.col("query_ids").alias("total_queries"),
        X.divide("latency_sum", "latency_count").alias("avg_latency_ms"),
        X.dbl("warehouse_credits").alias("credits_attributed_compute"),
    ).orderBy("user_name")


def daily_usage(matched: Pairs) -> DataFrame:
    """Matched queries per request date."""
    sums = pair_sums(matched, X.day("timestamp").alias("date")).filter(F.col("date").isNotNull())
    return sums.select("date", F.col("query_ids").alias("query_count")).orderBy("date")


def model_value_counts(matched: Pairs) -> DataFrame:
    """Pairs per model, most used first."""
    sums = pair_sums(matched, MODEL).filter(F.col(MODEL).isNotNull())
    return sums.select(MODEL, F.col("pairs").alias("count")).orderBy(F.desc("count"), MODEL)


_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def latency_describe(matched: Pairs) -> DataFrame:
    """Count, mean, std, min, quartiles, max of generation and of execution milliseconds."""
    if isinstance(matched, DataFrame):
        both = F.array(
            F.struct(F.lit("generation_ms").alias("measure"), F.col("latency_ms").alias("ms")),
            F.struct(F.lit("execution_ms").alias("measure"), F.col("total_elapsed_time").alias("ms")),
        )
        hist = value_counts(matched.select(F.inline(both)), ["measure"], "ms")
    else:
        # How often a value counts is how many partners its text has.
        h = matched.history.groupBy("match_key", F.col("total_elapsed_time").alias("ms")).agg(F.count("*").alias("n"))
        l = matched.logs.groupBy("match_key", F.col("latency_ms").alias("ms")).agg(F.count("*").alias("n"))
        partners = lambda df: df.groupBy("match_key").agg(F.sum("n").alias("partners"))
        generation = l.join(partners(h), "match_key").withColumn("measure", F.lit("generation_ms"))
        execution = h.join(partners(l), "match_key").withColumn("measure", F.lit("execution_ms"))
        both = generation.unionByName(execution)
        hist = value_counts(both, ["measure"], "ms", F.col("n") * F.col("partners"))
    stats = exact_stats(hist, ["measure"], _QUARTILES, with_std=True)
    return stats.select(
        "measure",
        F.col("n").alias("count"),
        "mean",
        "std",
        X.dbl("min").alias("min"),
        *_QUARTILES,
        X.dbl("max").alias("max"),
    ).orderBy("measure")


def mean_total_time(matched: Pairs) -> DataFrame:
    """One row: mean of generation plus execution milliseconds, rounded to a whole number."""
    if isinstance(matched, DataFrame):
        sums = matched.agg(F.sum("total_time").alias("s"), F.count("total_time").alias("n"))
    else:
        # total_time needs both parts, so only timed requests meet timed executions.
        l = matched.logs.groupBy("match_key").agg(
            F.sum("latency_ms").alias("l_ms"), F.count("latency_ms").alias("l_n")
        )
        h = matched.history.groupBy("match_key").agg(
            F.sum("total_elapsed_time").alias("h_ms"), F.count("total_elapsed_time").alias("h_n")
        )
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        sums = l.join(h, "match_key").agg(
            F.sum(wide("l_ms") * wide("h_n") + wide("h_ms") * wide("l_n")).alias("s"),
            F.sum(wide("l_n") * wide("h_n")).alias("n"),
        )
    return sums.select(F.rint(X.divide("s", "n")).cast("bigint").alias("avg_total_time_ms"))


def agent_inventory(tool_models: DataFrame) -> DataFrame:
    """One row: distinct agents, distinct semantic models, configurations."""
    return tool_models.agg(
        F.count_distinct("agent_name").alias("agents"),
        F.count_distinct("semantic_model_file").alias("semantic_models"),
        F.count("*").alias("configurations"),
    )


def total_agent_cost(agent_costs: DataFrame) -> DataFrame:
    """One row: sum of the per-agent totals."""
    return agent_costs.agg(X.dbl(X.sum_totals("total_credits")).alias("total_agent_credits"))
