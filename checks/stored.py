"""Queries over what the library writes: tables, snapshots and streams of the bound relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import AS_OF, AS_OF_ORDERS
from spendtrace.functions import exprs as X
from spendtrace.operators import budgets as H
from spendtrace.operators import usage as U
from spendtrace.operators.budgets import budget_rules
from spendtrace.operators.usage import service_usage
from spendtrace.session import shared_dir
from spendtrace.sources import day_rollup as R
from spendtrace.sources import sinks
from spendtrace.sources.extract import extract_request_log
from spendtrace.sources.tables import UsageTables
from spendtrace.streaming.batch_ingest import BATCH, ingest_batches
from spendtrace.streaming.budget_stream import budget_stream, stream_alerts

BATCHES = 3


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark, spark.conf.get('spark.sql.warehouse.dir'))}/{name}-{uuid.uuid4().hex}"


def table_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def streamed(df: DataFrame, path: str, batches: int = BATCHES) -> DataFrame:
    """The rows as a stream of ``batches`` micro-batches, from files written to ``path``: one a core and micro-batch."""
    spark = df.sparkSession
    df.repartition(batches * spark.sparkContext.defaultParallelism).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())  # few rows make fewer
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def appended_log(t: UsageTables) -> DataFrame:
    """K1, K2: the log appended twice holds each request once."""
    name, log = table_name("log"), extract_request_log(t.request_log_raw)
    for _ in range(2):
        sinks.append_logs(log, name)
    return t.spark.table(name).drop(sinks.LOG_DATE)


def loaded_log(t: UsageTables) -> DataFrame:
    """K6: the log replaced, then half of it added again."""
    name, log = table_name("log"), extract_request_log(t.request_log_raw)
    sinks.load_logs(log, name)
    sinks.load_logs(log, name)
    sinks.load_logs(log.where("response_status_code = 500"), name, mode="append")
    return t.spark.table(name).drop(sinks.LOG_DATE)


def built_history(t: UsageTables) -> DataFrame:
    """K3 to K5, K8: created, left alone, refreshed and replaced."""
    name = table_name("history")
    sources = (t.query_history, t.query_attribution)
    sinks.build_query_history(sources[0].limit(0), sources[1], name, AS_OF)
    sinks.build_query_history(*sources, name, AS_OF)
    assert sinks.table_exists(t.spark, name) and not t.spark.table(name).head(1)
    sinks.build_query_history(*sources, name, AS_OF, mode="refresh")
    sinks.build_query_history(*sources, name, AS_OF, mode="replace")
    return t.spark.table(name)


def ingested_log(t: UsageTables) -> DataFrame:
    """W2: the raw log streamed twice, by two queries, holds each request once."""
    name, place = table_name("log"), folder(t.spark, "ingest")
    source = streamed(t.request_log_raw, f"{place}/in")
    for k in range(2):
        finished(ingest_batches(source, name, f"{place}/checkpoint-{k}"))
    return t.spark.table(name).drop(sinks.LOG_DATE, BATCH)


def stream_alert_periods(t: UsageTables) -> DataFrame:
    """W1: the rules' periods that reach their limits in a stream of all usage."""
    place = folder(t.spark, "budget")
    source = streamed(service_usage(t), f"{place}/in")
    finished(budget_stream(source, budget_rules(t.spark), f"{place}/alerts", f"{place}/checkpoint"))
    # The total at which a rule alerts depends on what a micro-batch holds.
    reached = (F.col("total_credits") >= F.col("limit")).alias("reached")
    return stream_alerts(t.spark, f"{place}/alerts").select("rule", "period", "period_start", "limit", reached)


def day_totals(t: UsageTables) -> DataFrame:
    """H1 to H4, E19, E20: a rollup built before a quarter of the hours had come, then refreshed by what came late."""
    late = F.pmod(F.xxhash64(F.date_trunc("HOUR", "start_time")), F.lit(4)) == 0
    relations = ["metering", *[relation for relation, *_ in U.SERVICES.values()]]
    place = folder(t.spark, "days")
    early = UsageTables(t.spark, frames={r: t.get(r).where(~late) for r in relations})
    R.build_days(early, place)
    R.refresh_days(t, place, R.billed_rows(t).where(late).select(X.day("start_time").alias("day")))
    return R.read_days(t.spark, place)


_DAYS: dict[tuple, DataFrame] = {}


def over_days(report):
    """A report whose usage relations are the rollup's day totals; all such reports of a session share one rollup."""

    def run(t: UsageTables) -> DataFrame:
        place = (t.spark.sparkContext.applicationId, t.sf_dir)
        if place not in _DAYS:
            _DAYS[place] = day_totals(t)
        return report(R.usage_by_day(_DAYS[place]))

    return run


STORED = {
    "append_logs_result": appended_log,
    "load_logs_result": loaded_log,
    "build_query_history_result": built_history,
    "log_ingest_result": ingested_log,
    "budget_stream_alerts": stream_alert_periods,
    "day_rollup_budget_alert": over_days(lambda d: H.budget_alert(d, "MONTH", 10, AS_OF)),
    "day_rollup_functions_budget": over_days(lambda d: H.functions_budget(d.function_usage, "MONTH", 1000, AS_OF)),
    "day_rollup_custom_budget_alert": over_days(
        lambda d: H.custom_budget_alert(d.metering, "MONTH", 1000, "Acme Corporation", AS_OF_ORDERS)
    ),
    "day_rollup_budget_tiers": over_days(lambda d: H.budget_tiers(d, budget_rules(d.spark), AS_OF)),
    "day_rollup_daily_spend": over_days(lambda d: U.daily_spend(d.metering, AS_OF_ORDERS)),
    "day_rollup_top_spend_days": over_days(lambda d: U.top_spend_days(d.metering, AS_OF_ORDERS, events="events")),
}
