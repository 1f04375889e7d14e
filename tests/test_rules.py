"""One test per semantic rule that changes results."""

import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators import agent_costs as G
from spendtrace.operators import budgets as H
from spendtrace.operators import costs as C
from spendtrace.operators import latency as L
from spendtrace.operators import logs as D
from spendtrace.operators import usage as U
from spendtrace.sources import catalog as K
from spendtrace.sources import extract as E
from spendtrace.sources.tables import UsageTables
from tests.frames import T0, frame, logs, values

MODEL = "semantic_model_name"


def test_null_group_dropped_or_kept_by_path(spark):
    rows = [{MODEL: None}, {MODEL: ""}, {MODEL: "m"}, {MODEL: "m", "user_name": "u"}]
    l = logs(spark, rows)
    assert {r[0] for r in values(D.verified_query_count(l), MODEL)} == {"", "m"}
    assert {r[0] for r in values(D.query_type_view(l), MODEL)} == {None, "", "m"}
    assert values(D.user_activity(l), "user_name", MODEL) == [("u", "m")]


def test_rounding_by_path(spark):
    df = frame(spark, "v double, d decimal(10,4)", (0.125, Decimal("0.125")))
    row = df.select(X.half_even("v", 2).alias("even"), X.half_up("d", 2).alias("up")).first()
    assert (row.even, row.up) == (0.12, 0.13)
    assert frame(spark, "v double", (2.5,)).select(X.half_even("v", 0)).first()[0] == 2.0


def test_later_stages_read_rounded_values(spark):
    pairs = logs(
        spark,
        [
            {MODEL: "a", "request_credits": 0.00005, "request_id": "1"},
            {MODEL: "b", "request_credits": 0.00025, "request_id": "2"},
        ],
    ).withColumns({"credits_attributed_compute": F.lit(0.0), "query_id": F.lit("q")})
    got = {r[MODEL]: (r.total_credits, r.percentage_of_total_cost) for r in C.cost_breakdown_by_model(pairs).collect()}
    # 0.5 and 2.5 ten-thousandths round to 0 and 2, so all of the cost is b's.
    assert got == {"a": (0.0, 0.0), "b": (0.0002, 100.0)}


def test_counts_skip_nulls_where_the_reference_does(spark):
    l = logs(spark, [{MODEL: "m", "request_id": None, "user_name": "u"}, {MODEL: "m", "user_name": None}])
    row = D.model_usage_summary(l).first()
    assert (row.total_queries, row.unique_users) == (1, 1)
    assert D.log_coverage(l).first().log_count == 2


def test_top_queries_break_ties_by_name_then_question(spark):
    rows = [
        {MODEL: "m", "query_type": "Verified Query", "verified_query_name": f"n{i // 2:02d}",
         "verified_query_question": f"q{i % 2}"}
        for i in range(12)
    ]
    got = values(D.top_verified_queries(logs(spark, rows)), "verified_query_name", "verified_query_question")
    assert got == [(f"n{i // 2:02d}", f"q{i % 2}") for i in range(10)]
    shares = values(D.top_verified_queries(logs(spark, rows), 3), "percentage_of_verified_queries")
    assert shares == [(8.33,)] * 3  # of all twelve, not of the kept three


def test_largest_puts_null_last(spark):
    analyst = frame(
        spark,
        "timestamp timestamp_ntz, request_id string, user_question string, generated_sql string, "
        "analyst_latency_ms bigint, user_name string, semantic_model_name string",
        *[(T0, i, "q", "s", ms, "u", "m") for i, ms in (("a", None), ("b", 5), ("c", 9))],
    )
    assert values(L.slowest_requests(analyst, 3), "request_id") == [("c",), ("b",), ("a",)]


USAGE = "start_time timestamp_ntz, service_type string, credits_used double"


def test_window_is_inclusive(spark):
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    one = dt.timedelta(microseconds=1)
    rows = [(t, "AI_SERVICES", 1.0) for t in (start - one, start, end, end + one)]
    assert U.ai_services_total(frame(spark, USAGE, *rows), start, end).first()[0] == 2.0
    assert X.last_days(7, "2024-01-10") == (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 10, 23, 59, 59, 999999))


def test_empty_window_is_zero_or_null(spark):
    empty = frame(spark, USAGE, (T0, "OTHER", 1.0))
    assert U.ai_services_total(empty, "2020-01-01", "2020-01-02").first()[0] == 0.0
    functions = frame(spark, "start_time timestamp_ntz, token_credits double", (T0, 1.0))
    assert U.functions_total(functions, "2020-01-01", "2020-01-02").first()[0] is None


def test_zero_divisors_give_null_or_zero(spark):
    metering = frame(spark, USAGE, (T0, "AI_SERVICES", 5.0))
    row = H.custom_budget_alert(metering, "MONTH", 0, "Org", "2024-01-30").first()
    assert row.percentage_used is None and row.status == "EXCEEDED"


def test_first_model_is_the_earliest_known(spark):
    events = frame(
        spark,
        "event_time timestamp_ntz, event_date date, user_name string, agent_name string, model_name string, "
        "input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, "
        "total_tokens bigint",
        (T0, T0.date(), "u", "a", None, 1, 1, 1, 1, 4),
        (T0 + dt.timedelta(1), T0.date(), "u", "a", "later", 1, 1, 1, 1, 4),
        (T0 + dt.timedelta(0, 1), T0.date(), "v", "a", "zeta", 1, 1, 1, 1, 4),
    )
    row = G.agent_cost_by_agent(G.price_tokens(events)).first()
    assert (row.model_name, row.unique_users, row.token_credits) == ("zeta", 2, 0.0)


def test_token_prices(spark):
    schema = "model_name string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint"
    events = frame(
        spark, schema, ("claude-4-sonnet", 10**6, 10**6, 10**6, 10**6), ("claude-4-sonnet", None, 1, None, None),
        ("nobody", 10**6, 1, 1, 1), (None, 10**6, 1, 1, 1),
    )
    si = sorted(float(v[0]) for v in values(G.price_tokens(events, "SI"), "token_credits"))
    assert si == [0.0, 0.0, 0.00001255, 18.45]
    custom = frame(
        spark,
        "model_name string, input_rate double, output_rate double, cache_write_rate double, cache_read_rate double",
        ("nobody", 2.0, 0.0, 0.0, 0.0),
    )
    assert sorted(float(v[0]) for v in values(G.price_tokens(events, custom), "token_credits")) == [0.0, 0.0, 0.0, 2.0]
    # A model listed twice is charged once, at its highest rates.
    assert sorted(float(v[0]) for v in values(G.price_tokens(events, custom.union(custom)), "token_credits")) == [0.0, 0.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        G.price_tokens(events, "other")


def test_period_starts(spark):
    one = spark.range(1)
    start = lambda p, day: one.select(X.period_start(p, day)).first()[0]
    assert start("week", "2024-01-07") == dt.date(2024, 1, 1)
    assert start("WEEK", "2024-01-08") == dt.date(2024, 1, 8)
    assert start("Month", dt.datetime(2024, 2, 29, 23, 0)) == dt.date(2024, 2, 1)
    assert start(F.lit("day"), "2024-01-07") == dt.date(2024, 1, 7)
    with pytest.raises(ValueError):
        X.period_start("YEAR", "2024-01-07")
    with pytest.raises(Exception, match="invalid billing period"):
        start(F.lit("year"), "2024-01-07")


def test_agent_specs(spark):
    specs = {
        "broken": '{"tool_resources": {',
        "none": "{}",
        "null": None,
        "nofile": '{"tool_resources": {"t": {"x": 1}}}',
        "two": '{"tool_resources": {"a": {"semantic_model_file": "f1"}, "b.c": {"semantic_model_file": ""}}}',
    }
    agents = frame(spark, "name string, agent_spec string", *specs.items())
    assert sorted(values(K.agent_tool_models(agents)), key=repr) == [
        ("nofile", "t", None), ("two", "a", "f1"), ("two", "b.c", ""),
    ]
    assert values(K.agent_tool_models(agents, drop_null_files=True)) == [("two", "a", "f1")]


def test_json_extraction_copes_with_junk(spark):
    from spendtrace.schemas import REQUEST_LOG_RAW

    body = '{"messages":[{"content":[{"text":"why?"}]}]}'
    responses = ['{"response_metadata":{"analyst_latency_ms":123.7}}', '{"response_metadata":{"analyst_latency_ms":"55"}}',
                 '{"response_metadata":{"analyst_latency_ms":"n/a"}}', "not json", None]
    raw = spark.createDataFrame(
        [(T0, str(i), "m", None, "u", None, None, 200, body, r, None) for i, r in enumerate(responses)], REQUEST_LOG_RAW
    )
    out = E.extract_request_log(raw).orderBy("request_id")
    assert [r[0] for r in values(out, "latency_ms")] == [124, 55, None, None, None]
    assert {r[0] for r in values(out, "user_question")} == {"why?"}
    assert {r[0] for r in values(out, "query_type")} == {"Non-Verified Query"}


def test_query_type_pivot_fills_zero(spark):
    l = logs(spark, [{MODEL: "m"}, {MODEL: None}])
    assert values(D.query_type_pivot(l)) == [("m", 1, 0)]


def test_slowest_queries_drop_null_models(spark):
    l = logs(spark, [{MODEL: None, "latency_ms": 9}, {MODEL: "m", "latency_ms": 1005}, {MODEL: "m", "latency_ms": None}])
    assert values(D.slowest_queries(l), MODEL, "latency_seconds") == [("m", 1.0)]


def test_filters(spark):
    execs = frame(spark, "query_tag string, warehouse_name string", ("a", "w1"), ("", "w2"), (None, "w1"))
    assert L.filter_execs(execs).count() == 3
    assert L.filter_execs(execs, ["a"], ["All"]).count() == 1
    assert L.filter_execs(execs, [], ["w1"]).count() == 2
    assert values(L.query_tag_distribution(execs)) == [("", 1), ("a", 1)]
    users = frame(spark, "user_name string", ("u",), (None,))
    assert G.filter_users(users).count() == 1 and G.filter_users(users, ["x"]).count() == 0


def test_group_means_agree_with_headline(spark):
    sizes = [(2, 9910), (9, 5610), (1, 3120)]  # rows and mean of each model in the published sample report
    rows = [(f"m{i}", f"r{i}-{j}", ms) for i, (n, ms) in enumerate(sizes) for j in range(n)]
    analyst = frame(spark, "semantic_model_name string, request_id string, analyst_latency_ms bigint", *rows)
    assert round(L.gen_headline(analyst).first().avg_latency_sec, 2) == 6.12
    groups = L.gen_breakdown(analyst).collect()
    assert [(g.request_count, g.avg_latency_sec) for g in groups] == [(2, 9.91), (9, 5.61), (1, 3.12)]


def _tables(spark, day):
    t = lambda c: frame(spark, f"start_time timestamp_ntz, {c} double", (day, 30.0))
    return UsageTables(
        spark,
        frames={
            "function_usage": t("token_credits"),
            "analyst_usage": t("credits"),
            "document_usage": t("credits_used"),
            "search_usage": t("credits"),
        },
    )


def test_budget_toggles_and_levels(spark):
    tables = _tables(spark, dt.datetime(2024, 1, 20))
    row = H.budget_alert(tables, "month", 120, "2024-01-30", label="acme").first()
    assert row.total_credits == 120.0 and row.triggered and "Account: acme" in row.message
    assert not H.budget_alert(tables, "MONTH", 120, "2024-01-30", search=False).first().triggered
    assert H.budget_alert(tables, "DAY", 1, "2024-01-30").first().total_credits == 0.0
    off = H.budget_alert(tables, "DAY", 1, "2024-01-30", False, False, False, False).first()
    assert off.total_credits == 0.0 and off.search_credits == 0.0
    rules = H.budget_rules(
        spark,
        [("all", "MONTH", 150.0, True, True, True, True), ("one", "month", 30.0, False, False, False, True),
         ("week", "WEEK", 1.0, True, True, True, True), ("nothing", "DAY", 5.0, False, False, False, False)],
    )
    got = {r.rule: (r.total_credits, r.triggered, r.status) for r in H.budget_tiers(tables, rules, "2024-01-30").collect()}
    assert got == {
        "all": (120.0, False, "WARNING"),
        "one": (30.0, True, "EXCEEDED"),
        "week": (0.0, False, "OK"),
        "nothing": (0.0, False, "OK"),
    }


def test_warehouse_credits_repeat_or_not(spark):
    wm = frame(spark, "warehouse_id bigint, warehouse_name string, credits_used_compute double", (1, "w", 2.0), (1, "w", 3.0))
    use = frame(spark, "start_time timestamp_ntz, warehouse_id bigint, token_credits double", *[(T0, 1, 1.0)] * 3)
    window = ("2024-01-01", "2024-02-01")
    assert values(U.credits_by_warehouse(wm, use, *window)) == [("w", 1, 6.0, 15.0)]
    assert values(U.credits_by_warehouse(wm, use, *window, pre_aggregate=True)) == [("w", 1, 3.0, 5.0)]
