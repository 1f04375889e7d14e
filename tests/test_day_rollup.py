"""Day totals: refreshed day by day, read by period."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from spendtrace.operators import budgets as H
from spendtrace.operators import usage as U
from spendtrace.sources import day_rollup as R
from spendtrace.sources.tables import UsageTables
from tests.frames import values

METERING = "start_time timestamp_ntz, service_type string, credits_used double"


def tables(spark, metering, functions=()):
    at = lambda s: dt.datetime.fromisoformat(s) if s else None
    frames = {"metering": spark.createDataFrame([(at(t), s, c) for t, s, c in metering], METERING)}
    for relation, column, _ in U.SERVICES.values():
        rows = [(at(t), c) for t, c in functions] if relation == "function_usage" else []
        frames[relation] = spark.createDataFrame(rows, f"start_time timestamp_ntz, {column} double")
    return UsageTables(spark, frames=frames)


def days(spark, *dates):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in dates], "day date")


def totals(spark, path):
    rows = R.read_days(spark, path).select("source", "service", "day", "events", F.col("credits").cast("double"))
    return sorted((tuple(map(str, r)) for r in rows.collect()))


FIRST = [("2024-01-01 10:00:00", "AI", 1.5), ("2024-01-02 00:00:00", "AI", 2.0), ("2024-01-03 23:59:59", None, None)]


def test_late_rows_rewrite_their_day_only(spark, folder):
    path = f"{folder}/days"
    R.build_days(tables(spark, FIRST), path)
    before = {d: glob.glob(f"{d}/*.parquet") for d in glob.glob(f"{path}/day=*")}
    late = FIRST + [("2024-01-02 23:00:00", "AI", 3.0), ("2024-01-02 01:00:00", "OTHER", 1.0)]
    for _ in range(2):  # a repeat changes nothing
        R.refresh_days(tables(spark, late), path, days(spark, "2024-01-02", "2024-01-02"))
        assert totals(spark, path) == [
            ("metering", "AI", "2024-01-01", "1", "1.5"),
            ("metering", "AI", "2024-01-02", "2", "5.0"),
            ("metering", "None", "2024-01-03", "1", "None"),
            ("metering", "OTHER", "2024-01-02", "1", "1.0"),
        ]
    kept = {d for d, files in before.items() if glob.glob(f"{d}/*.parquet") == files}
    assert {os.path.basename(d) for d in kept} == {"day=2024-01-01", "day=2024-01-03"}


def test_a_day_that_lost_its_rows_is_empty(spark, folder):
    path = f"{folder}/days"
    R.build_days(tables(spark, FIRST, [("2024-01-02 05:00:00", 4.0)]), path)
    R.refresh_days(tables(spark, FIRST[:1]), path, days(spark, "2024-01-02", "2024-01-03"))
    assert totals(spark, path) == [("metering", "AI", "2024-01-01", "1", "1.5")]


def test_empty_tables_null_days_and_rows_without_time(spark, folder):
    path = f"{folder}/days"
    R.build_days(tables(spark, [(None, "AI", 1.0)]), path)
    R.refresh_days(tables(spark, FIRST), path, spark.createDataFrame([(None,)], "day date"))
    assert totals(spark, path) == []
    R.refresh_days(tables(spark, FIRST), path, days(spark, "2024-01-01"))
    assert len(totals(spark, path)) == 1


def test_alert_reads_only_the_days_of_its_period(spark, folder):
    path = f"{folder}/days"
    rows = [(f"2024-{m:02d}-{d:02d} 08:00:00", "AI_SERVICES", 1.0) for m in (1, 2, 3) for d in range(1, 21)]
    t = tables(spark, rows, [(at, c) for at, _, c in rows])
    R.build_days(t, path)
    by_day = R.usage_by_day(R.read_days(spark, path))
    got = U.daily_spend(by_day.metering, "2024-03-10")
    assert got.count() == U.daily_spend(t.metering, "2024-03-10").count() == 10
    alert = H.budget_alert(by_day, "MONTH", 5, "2024-03-10", documents=False, search=False)
    assert values(alert, "functions_credits", "triggered") == [(10.0, True)]
    scans = alert._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "day" in scans.split("PartitionFilters", 1)[1].split("]")[0]
    assert values(H.functions_budget(by_day.function_usage, "DAY", 5, "2024-02-03"), "current_usage_credits") == [(1.0,)]


def test_stream_of_arrivals_refreshes_their_days(spark, folder):
    path = f"{folder}/days"
    R.build_days(tables(spark, FIRST), path)
    now = tables(spark, FIRST + [("2024-02-01 00:00:00", "AI", 7.0)])
    now.metering.where("start_time > '2024-01-31'").write.parquet(f"{folder}/in")
    arrivals = spark.readStream.schema(now.metering.schema).parquet(f"{folder}/in")
    R.refresh_stream(arrivals, now, path, f"{folder}/checkpoint").awaitTermination()
    assert ("metering", "AI", "2024-02-01", "1", "7.0") in totals(spark, path) and len(totals(spark, path)) == 4
