"""Budget alerts from a stream, with their totals kept as keyed state.

The state of a (rule, period) is its total and whether it has alerted: a few
rows a rule, whatever the usage. An alert leaves the stream in the micro-batch
in which the total reaches the limit, once, and the file sink commits it with the batch.
So a repeated batch adds nothing, and no batch lists what others wrote.

Usage older than ``lateness`` behind the newest is dropped; a period's state
goes when that bound passes its end. The default spans a month, so late usage of
the running month counts. :func:`spendtrace.streaming.budget_monitor.budget_monitor` has no such bound.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendtrace.operators.usage import SERVICES

ALERTS = "rule string, period string, period_start date, `limit` double, total_credits double"
_STATE = "total string, alerted boolean"
_PART = "service string, day date, at timestamp, credits decimal(38,9)"


def _part_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credits per service and day of each Arrow batch, so that few rows reach the state."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(["service", "day"]).aggregate([("at", "max"), ("credits", "sum")])
            sums = sums.select(["service", "day", "at_max", "credits_sum"]).rename_columns(["service", "day", "at", "credits"])
            yield from sums.cast(pa.schema([*list(sums.schema)[:3], pa.field("credits", pa.decimal128(38, 9))])).to_batches()


def _watched(rules: DataFrame) -> DataFrame:
    """(rule, period, limit, service) per service that a rule counts."""
    services = F.filter(F.array(*[F.when(F.col(s), F.lit(s)) for s in SERVICES]), lambda s: s.isNotNull())
    return rules.select("rule", F.upper("period").alias("period"), F.col("limit").cast("double").alias("limit"), F.explode(services).alias("service"))


def _period_end(period: str, start: dt.date) -> dt.date:
    if period == "MONTH":
        return (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return start + dt.timedelta(days=7 if period == "WEEK" else 1)


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a batch's credits to the total of a (rule, period, period_start, limit); alert when it first reaches the limit."""
    if state.hasTimedOut:
        state.remove()
        return
    rule, period, start, limit = key
    total, alerted = (Decimal(state.get[0]), state.get[1]) if state.exists else (Decimal(0), False)
    for part in parts:
        total += sum((c for c in part["credits"] if c is not None), Decimal(0))
    if not alerted and limit is not None and float(total) >= limit:
        alerted = True
        yield pd.DataFrame([(rule, period, start, limit, float(total))], columns=["rule", "period", "period_start", "limit", "total_credits"])
    state.update((str(total), alerted))
    end = dt.datetime.combine(_period_end(period, start), dt.time(), dt.timezone.utc)
    state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))


def budget_stream(
    stream: DataFrame, rules: DataFrame, path: str, checkpoint: str, lateness: str = "32 days", available_now: bool = True
) -> StreamingQuery:
    """Write an alert per (rule, period) that reaches its limit to ``path``, from (service, start_time, credits) rows.

    Rows without service, time or credits count nowhere. Day, week and month begin in the session's time zone, which
    must be UTC as :func:`spendtrace.session.build_session` sets it.
    """
    rows = stream.where("service is not null and start_time is not null and credits is not null")
    rows = rows.select("service", F.to_date("start_time").alias("day"), F.col("start_time").cast("timestamp").alias("at"), F.col("credits").cast("decimal(28,9)").alias("credits"))
    parts = rows.mapInArrow(_part_totals, _PART).withWatermark("at", lateness)
    start = (
        F.when(F.col("period") == "DAY", F.col("day"))
        .when(F.col("period") == "WEEK", F.trunc("day", "week"))
        .when(F.col("period") == "MONTH", F.trunc("day", "month"))
        .otherwise(F.raise_error(F.lit("invalid billing period")).cast("date"))
    )
    keyed = parts.join(_watched(rules), "service").select("rule", "period", start.alias("period_start"), "limit", "at", "credits")
    alerts = keyed.groupBy("rule", "period", "period_start", "limit").applyInPandasWithState(
        advance, ALERTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    writer = alerts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of committed batches."""
    return spark.read.schema(ALERTS).parquet(path)
