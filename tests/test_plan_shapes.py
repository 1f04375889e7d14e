"""What the plans must look like to hold up on large inputs."""

import re
import tempfile

import pytest

from checks.bindings import BoundTables
from checks.queries import BUILDERS
from spendtrace.sources.tables import UsageTables

SF = "/root/testdata/sf0.001"
STORED = ("request_log_raw", "query_history", "query_attribution", "function_usage", "agent_events_raw", "metering")


@pytest.fixture(scope="module")
def stored(spark):
    """A few relations as files, to see what reaches the scan."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    bound = BoundTables(spark, SF)
    for name in STORED:
        bound.get(name).write.parquet(f"{folder}/{name}")
    return UsageTables(spark, {name: f"{folder}/{name}" for name in STORED})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """(columns, pushed filters) per file scan."""
    node = df._jdf.queryExecution().sparkPlan()
    leaves = node.collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "FileScan" in leaf.toString() or "Scan parquet" in leaf.nodeName():
            columns = set(re.findall(r"(\w+)#", leaf.output().mkString(",")))
            out.append((columns, leaf.verboseStringWithOperatorId()))
    return out


@pytest.mark.parametrize(
    "name, columns, pushed",
    [
        ("verified_query_count", {"semantic_model_name", "response_body"}, ["IsNotNull(semantic_model_name)"]),
        ("request_log_recent", None, ["GreaterThanOrEqual(timestamp,2024-01-16T00:00)"]),
        ("request_log_selected_models", None, ["In(semantic_model_name"]),
        ("analyst_latency_data", None, ["EqualTo(response_status_code,200)", "GreaterThanOrEqual(timestamp",
                                        "LessThanOrEqual(timestamp", "In(semantic_model_name|EqualTo(semantic_model"]),
        ("sql_execution_data", None, ["EqualTo(execution_status,SUCCESS)", "StringContains(query_text",
                                      "GreaterThanOrEqual(start_time"]),
        ("credits_by_model", {"start_time", "function_name", "model_name", "tokens", "token_credits"},
         ["EqualTo(function_name,COMPLETE)", "LessThanOrEqual(start_time"]),
        ("agent_sql_queries", None, ["GreaterThanOrEqual(timestamp,2024-01-10T00:00)"]),
        ("daily_spend", {"start_time", "service_type", "credits_used"}, ["GreaterThanOrEqual(start_time,2001-07-01T00:00)"]),
    ],
)
def test_scan_reads_and_filters_little(stored, name, columns, pushed):
    [(read, text)] = scans(BUILDERS[name][0](stored))
    if columns:
        assert read == columns
    for part in pushed:
        assert any(p in text for p in part.split("|")), (part, text)


@pytest.mark.parametrize("name", ["slowest_queries", "top_verified_queries", "slowest_combined"])
def test_top_k_per_group_is_cut_before_the_shuffle(stored, name):
    text = plan(BUILDERS[name][0](stored))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["slowest_requests", "slowest_executions", "credits_by_model", "top_spend_days"])
def test_global_top_k_is_not_a_sort(stored, name):
    assert "TakeOrderedAndProject" in plan(BUILDERS[name][0](stored))


@pytest.mark.parametrize("name", ["latency_summary", "gen_breakdown", "gen_headline", "top_verified_queries"])
def test_source_is_scanned_once(stored, name):
    df = BUILDERS[name][0](stored)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_a_known_tier_costs_three_scans_and_one_digest_a_side(stored):
    text = plan(BUILDERS["attribute_requests"][0](stored))
    assert text.count("FileScan") == 3 and text.count("sha2(") == 2
