"""Streams with state, exactly-once batches, and whole snapshots."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from checks.bindings import BoundTables
from checks.stored import finished, streamed
from spendtrace.operators.budgets import budget_rules
from spendtrace.schemas import REQUEST_LOG, REQUEST_LOG_RAW
from spendtrace.sources import sinks, snapshots
from spendtrace.sources.extract import extract_request_log
from spendtrace.streaming.batch_ingest import BATCH, ensure_batch_table, ingest_batches, write_batch
from spendtrace.streaming.budget_stream import budget_stream, stream_alerts
from spendtrace.streaming.log_ingest import ingest_logs
from tests.frames import logs, same_rows, values

SF = "/root/testdata/sf0.001"
USAGE = "service string, start_time timestamp_ntz, credits decimal(18,9)"


@pytest.fixture
def table():
    return f"t_{uuid.uuid4().hex[:12]}"


class Usage:
    """A folder of usage files read as a stream, one file a micro-batch, and the alerts of all runs."""

    def __init__(self, spark, folder, rules):
        self.spark, self.folder, self.rules = spark, folder, budget_rules(spark, rules)
        self.files = 0

    def add(self, *rows):
        rows = [(s, dt.datetime.fromisoformat(at) if at else None, c) for s, at, c in rows]
        df = self.spark.createDataFrame(rows, "service string, start_time timestamp_ntz, c double")
        df = df.select("service", "start_time", F.col("c").cast("decimal(18,9)").alias("credits"))
        self.files += 1
        df.coalesce(1).write.parquet(f"{self.folder}/in/{self.files:04d}")
        return self

    def run(self):
        source = self.spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        query = budget_stream(source, self.rules, f"{self.folder}/alerts", f"{self.folder}/checkpoint")
        finished(query)
        return query

    def alerts(self):
        return sorted(values(stream_alerts(self.spark, f"{self.folder}/alerts"), "rule", "period", "period_start", "total_credits"))


RULES = [("day", "DAY", 10.0, True, True, True, True), ("month", "month", 25.0, True, False, False, False)]


def test_alert_once_when_the_limit_is_reached(spark, folder):
    usage = Usage(spark, folder, [*RULES, ("both", "DAY", 10.0, False, False, False, True), ("both", "WEEK", 12.0, False, False, False, True)])
    usage.add(("functions", "2024-01-10 08:00:00", 6.0), ("functions", None, 99.0), (None, "2024-01-10 08:00:00", 99.0), ("functions", "2024-01-10 08:00:00", None))
    usage.run()
    assert usage.alerts() == []
    usage.add(("functions", "2024-01-10 09:00:00", 4.0)).run()
    assert usage.alerts() == [("day", "DAY", dt.date(2024, 1, 10), 10.0)]
    # More usage of that day alerts no more; one rule name in two periods has two totals.
    usage.add(("functions", "2024-01-10 09:30:00", 9.0), ("search", "2024-01-11 09:00:00", 11.0)).run()
    usage.add(("search", "2024-01-12 09:00:00", 2.0)).run()
    assert usage.alerts() == [
        ("both", "DAY", dt.date(2024, 1, 11), 11.0),
        ("both", "WEEK", dt.date(2024, 1, 8), 13.0),
        ("day", "DAY", dt.date(2024, 1, 10), 10.0),
        ("day", "DAY", dt.date(2024, 1, 11), 11.0),
    ]
    # Late usage of the running month still counts.
    usage.add(("functions", "2024-01-02 00:00:00", 6.5)).run()
    assert ("month", "MONTH", dt.date(2024, 1, 1), 25.5) in usage.alerts()


def test_repeated_batch_and_bounded_state(spark, folder):
    usage = Usage(spark, folder, RULES)
    for day in range(1, 13):
        usage.add(*[("functions", f"2024-01-{day:02d} {h:02d}:00:00", 6.0) for h in range(3)])
    query = usage.run()
    before = usage.alerts()
    assert len(before) == 13  # twelve days and the month
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 13  # a row per rule and period
    # The last batch's commit is lost, so it runs again.
    commits = sorted(glob.glob(f"{folder}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    crc = os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")
    for lost in (commits[-1], crc):
        os.remove(lost)
    usage.run()
    assert usage.alerts() == before
    # Months later the old periods' state is gone, and what is older than the bound counts no more.
    for at in ("2024-06-01 00:00:00", "2024-06-02 00:00:00", "2024-06-03 00:00:00"):
        usage.add(("functions", at, 1.0))
    usage.run()
    query = usage.add(("functions", "2024-01-20 00:00:00", 50.0), ("functions", "2024-06-04 00:00:00", 1.0)).run()
    assert usage.alerts() == before
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 5  # the days and the month of June


def test_unknown_period_is_an_error(spark, folder):
    usage = Usage(spark, folder, [("x", "YEAR", 1.0, True, True, True, True)]).add(("search", "2024-01-01 00:00:00", 1.0))
    with pytest.raises(Exception, match="invalid billing period"):
        usage.run()


def raw(spark):
    rows = BoundTables(spark, SF).request_log_raw.where("semantic_model_name is not null").limit(60)
    return rows.withColumn("request_id", F.when(F.col("request_id").substr(-1, 1) != "3", F.col("request_id")))


def test_ingest_loads_each_batch_once(spark, folder, table):
    source = streamed(raw(spark), f"{folder}/in")
    finished(ingest_batches(source, table, f"{folder}/checkpoint"))
    unnamed = raw(spark).where("request_id is null").count()
    assert spark.table(table).count() == 60 and unnamed > 0
    assert spark.table(table).where("request_id is null").count() == unnamed
    assert spark.table(table).select(BATCH).distinct().count() == 3
    # Lost commits: the last batch runs again, rows without id included.
    commits = sorted(glob.glob(f"{folder}/checkpoint/commits/[0-9]*"))
    for lost in (commits[-1], os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")):
        os.remove(lost)
    finished(ingest_batches(source, table, f"{folder}/checkpoint"))
    spark.catalog.refreshTable(table)
    assert spark.table(table).count() == 60
    # Another query of the same source adds only what nothing tells apart: rows without id.
    finished(ingest_batches(source, table, f"{folder}/other"))
    spark.catalog.refreshTable(table)
    assert spark.table(table).count() == 60 + unnamed


def test_only_new_requests_are_parsed_by_all_tasks(spark, folder, table, monkeypatch):
    """One file of repeated requests: each new one is parsed once, in the tasks of the shuffle; known ones are not."""
    parsed, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body, first):
        parsed.add(1)
        tasks.add(1 if first else 0)
        return body

    def extract(rows):
        tagged = rows.withColumn("_task", F.monotonically_increasing_id() % (1 << 33) == 0)
        return extract_request_log(tagged.withColumn("response_body", counted("response_body", "_task")))

    monkeypatch.setattr("spendtrace.streaming.batch_ingest.extract_request_log", extract)
    monkeypatch.setattr("spendtrace.streaming.log_ingest.extract_request_log", extract)
    at, body = dt.datetime(2024, 1, 5, 8), '{"response_metadata":{"analyst_latency_ms":7}}'
    rows = [(at, f"r{k % 50}", "m", None, "u", "API", None, 200, "{}", body, "SELECT 1") for k in range(100)]
    rows += [(at, None, "m", None, "u", "API", None, 200, "{}", body, "SELECT 1")] * 2
    spark.createDataFrame(rows, REQUEST_LOG_RAW).coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(REQUEST_LOG_RAW).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    try:
        finished(ingest_batches(source, table, f"{folder}/checkpoint"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parsed.value == 52 and tasks.value > 1
    assert spark.table(table).where("latency_ms = 7").count() == 52
    finished(ingest_batches(source, table, f"{folder}/other"))
    spark.catalog.refreshTable(table)
    assert parsed.value == 54 and spark.table(table).count() == 54  # only the two without id, which nothing tells apart
    finished(ingest_logs(source, f"{table}_log", f"{folder}/log"))
    finished(ingest_logs(source, f"{table}_log", f"{folder}/log-again"))
    assert parsed.value == 54 + 54 and spark.table(f"{table}_log").count() == 54


def test_stream_has_a_file_for_each_core(spark, folder):
    """A micro-batch is read by all cores, not by one."""
    streamed(spark.range(1000).repartition(2), f"{folder}/in")
    assert len(glob.glob(f"{folder}/in/*.parquet")) == 3 * spark.sparkContext.defaultParallelism


def test_write_batch_replaces_itself_and_respects_others(spark, table, folder):
    ensure_batch_table(spark, table)
    first = logs(spark, [{"semantic_model_name": "m"}, {"semantic_model_name": "m", "request_id": None}, {"semantic_model_name": None}])
    write_batch(first, table, "a-0", f"{folder}/staged")
    write_batch(first, table, "a-0", f"{folder}/staged")
    assert spark.table(table).count() == 2
    write_batch(logs(spark, [{"semantic_model_name": "m"}, {"semantic_model_name": "n", "request_id": "r7", "timestamp": None}]), table, "a-1", f"{folder}/staged")
    assert sorted(values(spark.table(table), "request_id", BATCH), key=str) == [("r0", "a-0"), ("r7", "a-1"), (None, "a-0")]
    write_batch(spark.createDataFrame([], REQUEST_LOG), table, "a-2", f"{folder}/staged")
    assert spark.table(table).count() == 3


def test_snapshots_are_whole(spark, table):
    snapshots.publish(spark.range(3), table)
    assert snapshots.is_view(spark, table) and spark.table(table).count() == 3
    failing = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        snapshots.publish(failing, table)
    assert spark.table(table).count() == 3  # a failed write leaves the old rows
    reader = spark.table(table)
    snapshots.publish(spark.range(7).withColumn("more", F.lit("x")), table)
    assert spark.table(table).columns == ["id", "more"] and spark.table(table).count() == 7
    assert reader.count() == 3  # a reader that began before goes on with its version
    assert len(snapshots.versions(spark, table)) == 2
    snapshots.publish(spark.range(1), table)
    assert len(snapshots.versions(spark, table)) == 2
    snapshots.roll_back(spark, table)
    assert spark.table(table).count() == 7
    with pytest.raises(ValueError):
        snapshots.roll_back(spark, table)
    with pytest.raises(ValueError):
        snapshots.publish(spark.range(1), table, keep=0)


def test_plain_table_becomes_a_version(spark, table):
    spark.range(4).write.saveAsTable(table)
    snapshots.publish(spark.range(2), table)
    assert snapshots.is_view(spark, table) and spark.table(table).count() == 2
    snapshots.roll_back(spark, table)
    assert spark.table(table).count() == 4


def test_failed_refresh_keeps_the_history(spark, table):
    t = BoundTables(spark, SF)
    assert sinks.build_query_history(t.query_history, t.query_attribution, table, "2024-01-30")
    want = spark.table(table).count()
    broken = t.query_history.withColumn("query_text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.build_query_history(broken, t.query_attribution, table, "2024-01-30", mode="refresh")
    assert spark.table(table).count() == want > 0
    same_rows(spark.table(table), spark.table(snapshots.versions(spark, table)[-1]))
