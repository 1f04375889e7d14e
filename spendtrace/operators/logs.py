"""Rollups of the processed request log.

Functions marked "dataframe rules" drop NULL group keys and round half to even;
those marked "SQL rules" keep a NULL group and round half up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators.stats import exact_stats, value_counts
from spendtrace.schemas import NON_VERIFIED, VERIFIED

MODEL = "semantic_model_name"


def verified_query_count(logs: DataFrame) -> DataFrame:
    """Requests per (model, query type) and share within the model. Dataframe rules."""
    counts = logs.filter(F.col(MODEL).isNotNull()).groupBy(MODEL, "query_type").agg(
        F.count("*").alias("request_count")
    )
    # At most two rows per model are left here.
    in_model = F.sum("request_count").over(Window.partitionBy(MODEL))
    return counts.withColumn("percentage", X.percent_half_even("request_count", in_model)).orderBy(
        MODEL, F.desc("request_count"), "query_type"
    )


def top_verified_queries(logs: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent curated queries per model; shares are taken before the cut.

    Model totals come from their own aggregate and are joined to the kept rows,
    so a model with many curated queries is never gathered in one task.
    """
    name, question = "verified_query_name", "verified_query_question"
    groups = (
        logs.filter(F.col("query_type") == VERIFIED)
        .dropna(subset=[MODEL, name, question])
        .groupBy(MODEL, name, question)
        .agg(F.count("*").alias("frequency"))
    )
    totals = groups.groupBy(MODEL).agg(F.sum("frequency").alias("_in_model"))
    best_first = Window.partitionBy(MODEL).orderBy(F.desc("frequency"), name, question)
    top = groups.withColumn("_place", F.row_number().over(best_first)).filter(F.col("_place") <= n)
    return (
        top.join(totals, MODEL)
        .select(
            MODEL,
            name,
            question,
            "frequency",
            X.percent_half_even("frequency", "_in_model").alias("percentage_of_verified_queries"),
        )
        .orderBy(MODEL, F.desc("frequency"), name, question)
    )


def slowest_queries(logs: DataFrame, n: int = 10) -> DataFrame:
    """Slowest requests per model, by seconds rounded to 2 digits."""
    rows = logs.filter(F.col("latency_ms").isNotNull() & F.col(MODEL).isNotNull()).select(
        MODEL,
        "user_question",
        X.ms_to_s("latency_ms", 2).alias("latency_seconds"),
        "orchestration_path",
        "question_category",
        "request_id",
    )
    slowest_first = Window.partitionBy(MODEL).orderBy(F.desc("latency_seconds"), "request_id")
    return (
        rows.withColumn("_place", F.row_number().over(slowest_first))
        .filter(F.col("_place") <= n)
        .orderBy(MODEL, "_place")
        .drop("_place", "request_id")
    )


def latency_summary(logs: DataFrame) -> DataFrame:
    """Count, mean, median, min, max of the rounded seconds per model. Dataframe rules."""
    rows = logs.filter(F.col("latency_ms").isNotNull() & F.col(MODEL).isNotNull())
    centis = F.rint(F.col("latency_ms") / F.lit(1000.0) * F.lit(100.0))
    stats = exact_stats(value_counts(rows, [MODEL], centis), [MODEL], {"median": 0.5})
    seconds = lambda c: X.half_even(F.col(c) / F.lit(100.0), 2)
    return stats.select(
        MODEL,
        F.col("n").alias("query_count"),
        seconds("mean").alias("avg_latency_seconds"),
        seconds("median").alias("median_latency_seconds"),
        seconds("min").alias("min_latency_seconds"),
        seconds("max").alias("max_latency_seconds"),
    ).orderBy(MODEL)


def user_activity(logs: DataFrame) -> DataFrame:
    """Requests, mean latency, credits per (user, model) and share of the user. Dataframe rules."""
    grouped = (
        logs.dropna(subset=["user_name", MODEL])
        .groupBy("user_name", MODEL)
        .agg(
            F.count("request_id").alias("queries_count"),
            X.half_even(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
            X.half_even(X.sum_credits("request_credits"), 2).alias("total_credits"),
        )
    )
    # One row per model of a user: a short group.
    of_user = F.sum("queries_count").over(Window.partitionBy("user_name"))
    share = X.half_even(X.divide("queries_count", of_user) * F.lit(100.0), 2)
    return grouped.withColumn("percentage_of_user_queries", share).orderBy(
        "user_name", F.desc("queries_count"), MODEL
    )


def model_usage_summary(logs: DataFrame) -> DataFrame:
    """Requests, users, mean latency, credits per model and share of all. Dataframe rules."""
    grouped = (
        logs.filter(F.col(MODEL).isNotNull())
        .groupBy(MODEL)
        .agg(
            F.count("request_id").alias("total_queries"),
            F.count_distinct("user_name").alias("unique_users"),
            X.half_even(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
            X.half_even(X.sum_credits("request_credits"), 2).alias("total_request_credits"),
        )
    )
    # One row per model is left, so the unpartitioned window is small.
    overall = F.sum("total_queries").over(Window.partitionBy())
    share = X.half_even(X.divide("total_queries", overall) * F.lit(100.0), 2)
    return grouped.withColumn("percentage", share).orderBy(F.desc("total_queries"), MODEL)


def query_type_view(logs: DataFrame) -> DataFrame:
    """Requests, share, mean latency, credits per (model, query type). SQL rules."""
    grouped = logs.groupBy(MODEL, "query_type").agg(
        F.count("*").alias("request_count"),
        F.sum("latency_ms").alias("_latency"),
        F.count("latency_ms").alias("_timed"),
        X.dbl(X.sum_credits("request_credits")).alias("total_request_credits"),
    )
    in_model = F.sum("request_count").over(Window.partitionBy(MODEL))
    return grouped.select(
        MODEL,
        "query_type",
        "request_count",
        X.percent_half_up("request_count", in_model).alias("percentage"),
        X.half_up(X.decimal_divide("_latency", "_timed"), 2).alias("avg_latency_ms"),
        "total_request_credits",
    ).orderBy(F.asc_nulls_last(MODEL), F.desc("request_count"))


def daily_usage_by_model(logs: DataFrame) -> DataFrame:
    """Requests and users per (date, model). Dataframe rules."""
    return (
        logs.select(X.day("timestamp").alias("date"), MODEL, "request_id", "user_name")
        .dropna(subset=["date", MODEL])
        .groupBy("date", MODEL)
        .agg(
            F.count("request_id").alias("queries_count"),
            F.count_distinct("user_name").alias("unique_users"),
        )
        .orderBy("date", MODEL)
    )


def log_coverage(logs: DataFrame) -> DataFrame:
    """Rows, first and last timestamp per model. SQL rules."""
    return (
        logs.groupBy(MODEL)
        .agg(
            F.count("*").alias("log_count"),
            F.min("timestamp").alias("earliest_log"),
            F.max("timestamp").alias("latest_log"),
        )
        .orderBy(F.desc("log_count"), F.asc_nulls_last(MODEL))
    )


def query_type_share(logs: DataFrame) -> DataFrame:
    """Requests per query type and share of all. SQL rules."""
    grouped = logs.groupBy("query_type").agg(F.count("*").alias("count"))
    overall = F.sum("count").over(Window.partitionBy())  # two rows
    return grouped.withColumn("percentage", X.percent_half_up("count", overall)).orderBy(F.desc("count"))


def query_type_pivot(logs: DataFrame) -> DataFrame:
    """Model by query type matrix of request counts; missing cells are 0."""
    return (
        logs.filter(F.col(MODEL).isNotNull())
        .groupBy(MODEL)
        .pivot("query_type", [NON_VERIFIED, VERIFIED])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .withColumnsRenamed({NON_VERIFIED: "non_verified_queries", VERIFIED: "verified_queries"})
        .orderBy(MODEL)
    )


def sample(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows of a report (in the report's own order)."""
    return df.limit(n)
