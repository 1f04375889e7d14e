import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks.bindings import AS_OF, BoundTables
from spendtrace.operators.budgets import EXAMPLE_RULES, budget_rules
from spendtrace.operators.usage import service_usage
from spendtrace.sources.extract import extract_request_log
from spendtrace.streaming.budget_monitor import budget_monitor, period_totals, day_totals, read_alerts
from spendtrace.streaming.log_ingest import ingest_logs
from tests.frames import same_rows, values

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path, files):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query):
    query.awaitTermination(600)
    assert query.exception() is None


def test_alerts_equal_the_batch_result(spark, folder):
    usage = service_usage(BoundTables(spark, SF))
    rules = budget_rules(spark, [r for r in EXAMPLE_RULES if r[0] != "production"] + [("tiny", "DAY", 1.0, *[True] * 4)])
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    source = stream_of(spark, usage, f"{folder}/in", 3)
    run(budget_monitor(source, rules, out, checkpoint))
    keys = ["rule", "period", "period_start", "limit"]
    want = period_totals(rules, day_totals(usage)).filter("total_credits >= limit").select(keys)
    got = read_alerts(spark, out)
    same_rows(got.select(keys), want)
    assert got.count() > 10

    # Starting again finds nothing new; late usage of an old day still counts.
    run(budget_monitor(source, rules, out, checkpoint))
    assert read_alerts(spark, out).count() == got.count()
    late = spark.createDataFrame([("search", dt.datetime(2023, 6, 1, 5))], "service string, start_time timestamp_ntz")
    late = late.withColumn("credits", F.lit(99999).cast("decimal(18,9)")).select(usage.columns)
    late.write.mode("append").parquet(f"{folder}/in")
    run(budget_monitor(source, rules, out, checkpoint))
    new = read_alerts(spark, out).filter("period_start < '2023-12-01'")
    assert ("monthly_review", dt.date(2023, 6, 1)) in values(new, "rule", "period_start")
    assert new.filter("rule = 'tiny'").count() == 1


def test_ingest_adds_each_request_once(spark, folder):
    raw = BoundTables(spark, SF).request_log_raw
    table = f"log_{uuid.uuid4().hex[:12]}"
    source = stream_of(spark, raw.union(raw.limit(200)), f"{folder}/in", 2)
    run(ingest_logs(source, table, f"{folder}/checkpoint"))
    want = extract_request_log(raw).filter("semantic_model_name IS NOT NULL")
    same_rows(spark.table(table).drop("log_date"), want)
    # A second reader of the same files adds nothing.
    run(ingest_logs(source, table, f"{folder}/other"))
    assert spark.table(table).count() == want.count()


def test_ingest_with_watermark(spark, folder):
    raw = BoundTables(spark, SF).request_log_raw
    table = f"log_{uuid.uuid4().hex[:12]}"
    source = stream_of(spark, raw.union(raw.limit(200)), f"{folder}/in", 1)
    run(ingest_logs(source, table, f"{folder}/checkpoint", watermark="1 hour"))
    assert spark.table(table).count() == raw.filter("semantic_model_name IS NOT NULL").count()
