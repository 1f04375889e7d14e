"""Usage reduced once to (source, service, day) totals, from which budgets and daily reports read.

The rollup is a Parquet folder partitioned by day. A refresh computes whole days
from the relations and overwrites just those partitions, so late rows, corrected
rows and a repeated refresh all give what a rebuild would; days that lost all
their rows are emptied. A report reads the partitions of its period: a few rows
a day, whatever the number of usage rows.

The reports of ``operators.budgets`` and ``operators.usage`` run unchanged over
:func:`metering_by_day` and :func:`usage_by_day`. A day is the smallest unit here,
so their ``as_of`` must be a date, not an instant. A service's day holds less than 10^9 credits.

Defined results: rows without time belong to no day and are left out, as the reports
leave them out; a NULL service is kept as such; a day whose credits are all NULL has
NULL credits and its number of events. Columns other than those of the relations are ignored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendtrace.functions import exprs as X
from spendtrace.operators.usage import SERVICES, service_usage
from spendtrace.sources.tables import UsageTables

USAGE, METERING = "usage", "metering"
SCHEMA = "source string, service string, events bigint, credits decimal(28,9), day date"


def billed_rows(tables: UsageTables) -> DataFrame:
    """(source, service, start_time, credits) of the four services' usage and of the metering."""
    usage = service_usage(tables).select(F.lit(USAGE).alias("source"), "service", "start_time", "credits")
    metered = tables.metering.select(
        F.lit(METERING).alias("source"),
        F.col("service_type").alias("service"),
        "start_time",
        X.credits("credits_used").alias("credits"),
    )
    return usage.unionByName(metered)


def _totals(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("source", "service", X.day("start_time").alias("day")).agg(
        F.count("*").alias("events"), F.sum("credits").cast("decimal(28,9)").alias("credits")
    )
    return totals.select("source", "service", "events", "credits", "day")


def build_days(tables: UsageTables, path: str) -> None:
    """Write the rollup of all days, in place of whatever is at ``path``."""
    totals = _totals(billed_rows(tables).where(F.col("start_time").isNotNull()))
    _write(totals, path, "static")


def refresh_days(tables: UsageTables, path: str, days: DataFrame) -> None:
    """Recompute the days in ``days`` (a date column ``day``) from the relations; other days stay as they are.

    Only rows from the first to the last of these days are read. Days without any
    row left are written as a row without events, which hides what they held.
    """
    days = days.select("day").where("day is not null").distinct()
    first, last = days.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    start, after = (X.moment(d) for d in (first, last + dt.timedelta(days=1)))
    rows = billed_rows(tables).where((F.col("start_time") >= start) & (F.col("start_time") < after))
    totals = days.join(_totals(rows), "day", "left").select(
        "source", "service", F.coalesce("events", F.lit(0)).alias("events"), "credits", "day"
    )
    _write(totals, path, "dynamic")


def _write(totals: DataFrame, path: str, overwrite: str) -> None:
    """One file a day: the rows are already reduced, a few for each service."""
    writer = totals.repartition("day").write.partitionBy("day").mode("overwrite")
    writer.option("partitionOverwriteMode", overwrite).parquet(path)


def refresh_stream(arrivals: DataFrame, tables: UsageTables, path: str, checkpoint: str) -> StreamingQuery:
    """Refresh the days that a stream of new rows (``start_time``) touches, batch by batch, until none is left.

    ``tables`` already hold the rows. Whole days are recomputed, so a repeated batch changes nothing.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        refresh_days(tables, path, batch.select(X.day("start_time").alias("day")))

    writer = arrivals.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where("events > 0")


def _midnight() -> Column:
    # An expression of the partition column alone: period filters prune partitions.
    return F.col("day").cast("timestamp_ntz").alias("start_time")


def metering_by_day(days: DataFrame) -> DataFrame:
    """The rollup in the shape of the metering relation, with ``events`` a row stands for."""
    rows = days.where(F.col("source") == METERING)
    return rows.select(_midnight(), F.col("service").alias("service_type"), F.col("credits").alias("credits_used"), "events")


def usage_by_day(days: DataFrame) -> UsageTables:
    """The rollup in the shape of the four usage relations and the metering."""
    frames = {"metering": metering_by_day(days)}
    for service, (relation, column, _) in SERVICES.items():
        rows = days.where((F.col("source") == USAGE) & (F.col("service") == service))
        frames[relation] = rows.select(_midnight(), F.col("credits").alias(column), "events")
    return UsageTables(days.sparkSession, frames=frames)
