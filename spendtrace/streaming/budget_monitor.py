"""Budget monitoring over a stream of usage rows, in place of polling tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendtrace.functions import exprs as X
from spendtrace.operators.usage import SERVICES

_TOTALS = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("credits", T.DecimalType(28, 9)),
        T.StructField("batch_id", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)
_ALERTS = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("period_start", T.DateType()),
        T.StructField("limit", T.DoubleType()),
        T.StructField("total_credits", T.DoubleType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def day_totals(usage: DataFrame) -> DataFrame:
    """Credits per service and tumbling day window of (service, start_time, credits) rows."""
    at = F.col("start_time").cast("timestamp")
    windows = usage.groupBy("service", F.window(at, "1 day").alias("w")).agg(F.sum("credits").alias("credits"))
    return windows.select("service", F.to_date("w.start").alias("day"), F.col("credits").cast("decimal(28,9)"))


def period_totals(rules: DataFrame, totals: DataFrame) -> DataFrame:
    """Credits of every (rule, period) that the day totals reach into."""
    watched = F.filter(F.array(*[F.when(F.col(s), F.lit(s)) for s in SERVICES]), lambda s: s.isNotNull())
    by_service = rules.select("rule", F.upper("period").alias("period"), "limit", F.explode(watched).alias("service"))
    start = (
        F.when(F.col("period") == "DAY", F.col("day"))
        .when(F.col("period") == "WEEK", F.trunc("day", "week"))
        .when(F.col("period") == "MONTH", F.trunc("day", "month"))
        .otherwise(F.raise_error(F.lit("invalid billing period")).cast("date"))
    )
    return (
        by_service.join(totals, "service")
        .groupBy("rule", "period", start.alias("period_start"), "limit")
        .agg(F.sum("credits").alias("total"))
        .select("rule", "period", "period_start", "limit", X.dbl("total").alias("total_credits"))
    )


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _seed(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> None:
    """An empty first partition, so that the very first batch has something to read."""
    columns = [f for f in schema if f.name not in ("batch_id", "month")]
    spark.createDataFrame([], T.StructType(columns)).write.mode("ignore").parquet(f"{path}/{partition}")


def _months_back(day: dt.date) -> str:
    """Month in which the longest period that holds ``day`` can begin (a week may reach back)."""
    return (day - dt.timedelta(days=day.weekday())).strftime("%Y-%m")


def budget_monitor(
    stream: DataFrame, rules: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append one alert per (rule, period) that reaches its limit, under ``path/alerts``.

    Each micro-batch adds its own day totals and nothing is ever held in
    memory between batches, so late usage still counts. Every batch writes
    partitions named by its id: a repeated batch replaces what it wrote.
    """
    spark = stream.sparkSession
    totals_path, alerts_path = f"{path}/day_totals", f"{path}/alerts"
    _seed(spark, totals_path, _TOTALS, "batch_id=-1/month=none")
    _seed(spark, alerts_path, _ALERTS, "batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = f"{totals_path}/batch_id={batch_id}"
        by_month = day_totals(batch).withColumn("month", F.date_format("day", "yyyy-MM"))
        by_month.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(own)
        parts = _stored(session, totals_path, _TOTALS).filter(F.col("batch_id") <= batch_id)
        first_day = parts.filter(F.col("batch_id") == batch_id).agg(F.min("day")).first()[0]
        if first_day is None:
            return
        # Only periods that this batch reaches into can cross a limit now.
        parts = parts.filter(F.col("month").between(_months_back(first_day), "9999-12"))
        totals = parts.groupBy("service", "day").agg(F.sum("credits").alias("credits"))
        sent = _stored(session, alerts_path, _ALERTS).filter(F.col("batch_id") < batch_id)
        reached = period_totals(rules, totals).filter(F.col("total_credits") >= F.col("limit"))
        fresh = reached.join(sent, ["rule", "period", "period_start"], "left_anti")
        fresh.select(*_ALERTS.names[:-1]).write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/alerts", _ALERTS)
