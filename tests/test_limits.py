"""Large and junk values: sums beyond one row's credits, JSON numbers no bigint holds, many pairs, repeated rule names."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators import costs, stats
from spendtrace.sources.extract import _whole
from spendtrace.streaming.budget_monitor import budget_monitor, read_alerts


def test_totals_above_a_billion_credits(spark):
    models = spark.createDataFrame([("m", "a", "t"), ("m", "b", "t")], "semantic_model_file string, agent_name string, tool_name string")
    totals = spark.createDataFrame([("m", Decimal("2700000000.5"))], "semantic_model_name string, total_credits decimal(28,9)")
    by_agent = costs.cost_by_agent(models, totals)
    assert {r.total_credits for r in by_agent.collect()} == {2700000000.5}
    assert costs.total_agent_cost(by_agent).first()[0] == 5400000001.0


def test_json_numbers_no_bigint_holds(spark):
    bodies = [('{"v": 1e300}', None), ('{"v": -1e19}', None), ('{"v": "NaN"}', None), ('{"v": "x"}', None), ('{"v": 2.5}', 3), ("{", None)]
    df = spark.createDataFrame(bodies, "body string, want long").withColumn("j", F.try_parse_json("body"))
    assert all(r.got == r.want for r in df.select(_whole("j", "$.v").alias("got"), "want").collect())


def test_spread_of_many_pairs(spark):
    n = 2 * 10**14
    hist = spark.createDataFrame([(20_000, n), (60_000, n)], "value long, rows long")
    row = stats.exact_stats(hist, with_std=True).first()
    assert row.n == 2 * n and row["mean"] == 40_000 and abs(row["std"] - 20_000) < 1e-3


def test_quotient_of_a_large_latency_sum(spark):
    row = spark.sql("SELECT CAST(2000000000000000000 AS DECIMAL(38,0)) AS s, CAST(40 AS DECIMAL(38,0)) AS n")
    assert float(row.select(X.decimal_divide("s", "n")).first()[0]) == 5e16


def test_up_to_a_day_or_an_instant(spark):
    df = spark.sql("SELECT CAST(column1 AS TIMESTAMP_NTZ) AS t FROM VALUES ('2024-01-10 00:00:00'), ('2024-01-10 12:00:00'), ('2024-01-10 23:59:59.999'), ('2024-01-11 00:00:00') AS v(column1)")
    assert df.filter(X.up_to("t", "2024-01-10")).count() == 3
    assert df.filter(X.up_to("t", dt.date(2024, 1, 10))).count() == 3
    assert df.filter(X.up_to("t", "2024-01-10 12:00:00")).count() == 2
    assert df.filter(X.up_to("t", dt.datetime(2024, 1, 10))).count() == 1


def test_rule_name_used_for_two_periods(spark, folder):
    rules = spark.createDataFrame(
        [("r", "DAY", 5.0, True, True, True, True), ("r", "MONTH", 10.0, True, True, True, True)],
        "rule string, period string, limit double, functions boolean, analyst boolean, documents boolean, search boolean",
    )
    schema = "service string, start_time timestamp_ntz, credits decimal(18,9)"
    for amount in (6, 16):
        rows = spark.createDataFrame([("search", dt.datetime(2024, 1, 1, 3), Decimal(amount))], schema)
        rows.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        budget_monitor(source, rules, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    alerts = sorted((r.period, str(r.period_start)) for r in read_alerts(spark, f"{folder}/out").collect())
    assert alerts == [("DAY", "2024-01-01"), ("MONTH", "2024-01-01")]
