from checks.bindings import AS_OF, END, START, BoundTables
from checks.queries import QUERIES
from spendtrace.operators import attribution as A
from spendtrace.operators import costs as C
from spendtrace.plans.agent_report import agent_report
from spendtrace.plans.attribution import run_attribution
from spendtrace.plans.latency_report import write_latency_report
from spendtrace.session import shared_dir
from spendtrace.sources.extract import recent_request_log
from spendtrace.sources.tables import UsageTables
from tests.frames import same_rows, values

import pytest

SF = "/root/testdata/sf0.001"


def test_attribution_job(spark, folder):
    t = BoundTables(spark, SF)
    out = run_attribution(t, AS_OF, folder)
    history = A.query_history_cost(t.query_history, t.query_attribution, AS_OF, how="left")
    matched = A.match_requests(history, recent_request_log(t.request_log_raw, AS_OF), (None, 100))
    same_rows(out["cost_breakdown"], C.cost_breakdown_by_model(matched))
    same_rows(out["cost_by_model"], C.total_cost_by_model(matched))
    shares = [r[0] for r in values(out["cost_breakdown"], "percentage_of_total_cost")]
    assert abs(sum(shares) - 100) < 0.1
    assert out["cost_by_agent"].count() > 5 and out["total_agent_cost"].count() == 1


def test_latency_report_tables(spark, folder):
    t = BoundTables(spark, SF)
    where = write_latency_report(t.request_log_raw, t.query_history, START, END, folder)
    read = lambda name: spark.read.parquet(where[name])
    for table, query in (
        ("generation_headline", "gen_headline"),
        ("generation_by_model", "gen_breakdown"),
        ("slowest_requests", "slowest_requests"),
        ("query_tags", "query_tag_distribution"),
        ("warehouses", "warehouse_distribution"),
    ):
        same_rows(read(table), QUERIES[query](spark, SF))
    assert "query_text" not in read("slowest_executions").columns
    assert read("requests").count() == read("generation_headline").first().row_count


def test_agent_report(spark):
    t = BoundTables(spark, SF)
    report = agent_report(t.agent_events_raw, t.query_history, AS_OF)
    same_rows(report["by_user"], QUERIES["agent_cost_by_user"](spark, SF))
    head = report["headline"].first()
    by_agent = report["by_agent"].collect()
    assert head.unique_agents == len(by_agent)
    assert abs(sum(r.token_credits for r in by_agent) - head.token_credits) < 1e-6
    some = agent_report(t.agent_events_raw, t.query_history, AS_OF, agents=["agent_1"], users=["user_1"])
    assert {r[0] for r in values(some["detail"], "agent_name", "user_name")} <= {"agent_1"}


def test_relations_by_path_table_or_frame(spark, folder):
    spark.range(3).write.parquet(f"{folder}/m")
    spark.range(2).createOrReplaceTempView("usage_view")
    t = UsageTables(spark, {"metering": f"{folder}/m", "agents": "usage_view"}, {"analyst_usage": spark.range(1)})
    assert (t.metering.count(), t.agents.count(), t.analyst_usage.count()) == (3, 2, 1)
    with pytest.raises(KeyError):
        t.get("search_usage")
    with pytest.raises(AttributeError):
        t.nothing


def test_shared_folder_comes_from_the_session(spark, folder):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        with pytest.raises(ValueError):
            shared_dir(spark)
    assert shared_dir(spark, folder) == (before or folder)
    assert shared_dir(spark, "/other") == (before or "/other")
