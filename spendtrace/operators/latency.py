"""Latency report: SQL generation, SQL execution, and both together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators.attribution import LatencyMatch
from spendtrace.operators.stats import exact_stats, value_counts

MODEL = "semantic_model_name"
_MEDIAN = {"median": 0.5}


def _seconds(c: str) -> Column:
    return F.col(c) / F.lit(1000.0)


def _grouped(df: DataFrame, key: str, measure: str, id_column: str, count_name: str) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull())
    hist = value_counts(rows, [key], measure, counts={count_name: F.count(id_column)})
    return exact_stats(hist, [key], _MEDIAN, [count_name]).select(
        key,
        count_name,
        X.half_even(_seconds("mean"), 2).alias("avg_latency_sec"),
        X.half_even(_seconds("median"), 2).alias("median_latency_sec"),
        X.half_even(_seconds("max"), 2).alias("max_latency_sec"),
    )


def _headline(df: DataFrame, measure: str) -> DataFrame:
    hist = value_counts(df, [], measure, counts={"row_count": F.count("*")})
    return exact_stats(hist, [], _MEDIAN, ["row_count"]).select(
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        _seconds("mean").alias("avg_latency_sec"),
        _seconds("median").alias("median_latency_sec"),
        _seconds("max").alias("max_latency_sec"),
    )


# --- generation -------------------------------------------------------------


def gen_breakdown(analyst: DataFrame) -> DataFrame:
    """Requests, mean, median, max seconds per model; slowest mean first."""
    return _grouped(analyst, MODEL, "analyst_latency_ms", "request_id", "request_count").orderBy(
        F.desc_nulls_last("avg_latency_sec"), MODEL
    )


def gen_headline(analyst: DataFrame) -> DataFrame:
    return _headline(analyst, "analyst_latency_ms")


def gen_series(analyst: DataFrame) -> DataFrame:
    """(timestamp, seconds), oldest first."""
    return analyst.select("timestamp", X.ms_to_s("analyst_latency_ms").alias("analyst_latency_sec")).orderBy(
        F.asc_nulls_last("timestamp")
    )


def slowest_requests(analyst: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` requests by latency; unknown latency last, ties newest first."""
    return (
        analyst.select(
            "timestamp",
            "request_id",
            "user_question",
            "generated_sql",
            X.ms_to_s("analyst_latency_ms").alias("analyst_latency_sec"),
            "user_name",
            MODEL,
        )
        .orderBy(F.desc_nulls_last("analyst_latency_sec"), F.desc_nulls_last("timestamp"), "request_id")
        .limit(n)
    )


def model_choices(analyst: DataFrame) -> DataFrame:
    return analyst.select(MODEL).dropna().distinct()


def filter_models(analyst: DataFrame, model: str = "All") -> DataFrame:
    return analyst if model == "All" else analyst.filter(F.col(MODEL) == model)


# --- execution --------------------------------------------------------------


def filter_execs(
    executions: DataFrame, tags: Sequence[str] = ("All",), warehouses: Sequence[str] = ("All",)
) -> DataFrame:
    """Keep chosen query tags and warehouses; 'All' or nothing chosen keeps everything."""
    for column, chosen in (("query_tag", tags), ("warehouse_name", warehouses)):
        if chosen and "All" not in chosen:
            executions = executions.filter(F.col(column).isin(list(chosen)))
    return executions


def exec_headline(executions: DataFrame) -> DataFrame:
    return _headline(executions, "execution_time_ms")


def exec_series(executions: DataFrame) -> DataFrame:
    """(start_time, seconds), oldest first."""
    return executions.select(
        "start_time", X.ms_to_s("execution_time_ms").alias("execution_latency_sec")
    ).orderBy(F.asc_nulls_last("start_time"))


def query_tag_distribution(executions: DataFrame) -> DataFrame:
    """Executions per query tag; NULL dropped, '' kept."""
    return (
        executions.filter(F.col("query_tag").isNotNull())
        .groupBy("query_tag")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "query_tag")
    )


def warehouse_distribution(executions: DataFrame) -> DataFrame:
    """Executions, mean, median, max seconds per warehouse; busiest first."""
    return _grouped(executions, "warehouse_name", "execution_time_ms", "query_id", "query_count").orderBy(
        F.desc("query_count"), "warehouse_name"
    )


def slowest_executions(executions: DataFrame, n: int = 10, with_text: bool = True) -> DataFrame:
    """Top ``n`` executions by time; unknown time last, ties newest first."""
    return (
        executions.select(
            "start_time",
            "query_id",
            "query_tag",
            *(["query_text"] if with_text else []),
            X.ms_to_s("execution_time_ms").alias("execution_latency_sec"),
            "user_name",
            "warehouse_name",
        )
        .orderBy(F.desc_nulls_last("execution_latency_sec"), F.desc_nulls_last("start_time"), "query_id")
        .limit(n)
    )


def exec_detail(executions: DataFrame) -> DataFrame:
    return executions.select(
        "start_time",
        "query_id",
        "query_tag",
        "query_text",
        X.ms_to_s("execution_time_ms").alias("execution_latency_sec"),
        "user_name",
        "warehouse_name",
        "execution_status",
    )


# --- combined ---------------------------------------------------------------
# Means and sums over the request-execution join need only per-text totals of
# each side, so the join below has one row per text on both sides.


def _per_text(match: LatencyMatch, how: str) -> DataFrame:
    requests = match.requests.groupBy("match_key").agg(
        F.count("*").alias("l_rows"),
        F.sum("analyst_latency_ms").alias("l_ms"),
        F.count("analyst_latency_ms").alias("l_timed"),
    )
    executed = match.executions
    if how == "inner":
        executed = executed.filter(F.col("query_id").isNotNull())
    executed = executed.groupBy("match_key").agg(
        F.count("*").alias("h_rows"),
        F.count("query_id").alias("h_ids"),
        F.sum("execution_time_ms").alias("h_ms"),
        F.count("execution_time_ms").alias("h_timed"),
    )
    return requests.join(executed, "match_key", how)


def _wide(c: Column | str) -> Column:
    return X.col(c).cast("decimal(18,0)")


def combined_headline(match: LatencyMatch) -> DataFrame:
    """One row: joined rows, matched rows, mean generation, execution and total seconds."""
    texts = _per_text(match, "left")
    times = F.coalesce("h_rows", F.lit(1))  # a request without execution still counts once
    product_sum = lambda a, b, name: F.sum(_wide(a) * _wide(b)).alias(name)
    sums = texts.agg(
        product_sum("l_rows", times, "rows"),
        product_sum("l_rows", "h_ids", "matched"),
        product_sum("l_ms", times, "gen"),
        product_sum("l_timed", times, "gen_n"),
        product_sum("h_ms", "l_rows", "exec"),
        product_sum("h_timed", "l_rows", "exec_n"),
    )
    zero = F.lit(0)
    both = F.coalesce("gen", zero) + F.coalesce("exec", zero)
    return sums.select(
        F.coalesce("rows", zero).cast("bigint").alias("joined_rows"),
        F.coalesce("matched", zero).cast("bigint").alias("matched_rows"),
        (X.divide("gen", "gen_n") / F.lit(1000.0)).alias("avg_generation_sec"),
        (X.divide("exec", "exec_n") / F.lit(1000.0)).alias("avg_execution_sec"),
        (X.divide(both, "rows") / F.lit(1000.0)).alias("avg_total_sec"),
    )


def latency_composition(match: LatencyMatch) -> DataFrame:
    """Seconds and percent of generation and execution over matched rows; 0 % of nothing."""
    sums = _per_text(match, "inner").agg(
        F.sum(_wide("l_ms") * _wide("h_rows")).alias("gen"),
        F.sum(_wide("h_ms") * _wide("l_rows")).alias("exec"),
    )
    zero = F.lit(0)
    sums = sums.select(F.coalesce("gen", zero).alias("gen"), F.coalesce("exec", zero).alias("exec"))
    both = F.col("gen") + F.col("exec")

    def part(name: str, c: str) -> Column:
        share = F.coalesce(X.divide(c, both) * F.lit(100.0), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("component"),
            share.alias("percentage"),
            (X.dbl(c) / F.lit(1000.0)).alias("total_time_sec"),
        )

    return sums.select(F.inline(F.array(part("SQL Generation", "gen"), part("SQL Execution", "exec"))))


def slowest_combined(match: LatencyMatch, n: int = 10) -> DataFrame:
    """Top ``n`` (request, execution) rows by total latency.

    A row among the ``n`` slowest joins one of the ``n`` slowest requests of
    its text with one of the ``n`` slowest executions, so each side is cut to
    that before the join; the result is the same as over all pairs.
    """

    def slowest_per_text(df: DataFrame, ms: str, tie: str) -> DataFrame:
        order = Window.partitionBy("match_key").orderBy(F.desc(F.coalesce(ms, F.lit(0))), tie)
        return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")

    cut = LatencyMatch(
        slowest_per_text(match.requests, "analyst_latency_ms", "request_id"),
        slowest_per_text(match.executions, "execution_time_ms", "query_id"),
    )
    return (
        cut.pairs()
        .select(
            "request_id",
            "query_id",
            "user_question",
            "generated_sql",
            "analyst_latency_sec",
            "execution_latency_sec",
            "total_latency_sec",
            "warehouse_name",
            MODEL,
        )
        .orderBy(F.desc("total_latency_sec"), "request_id", "query_id")
        .limit(n)
    )


def combined_series(joined: DataFrame) -> DataFrame:
    """Generation and execution seconds of every joined row."""
    return joined.select("analyst_latency_sec", "execution_latency_sec")
