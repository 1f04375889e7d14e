import random

import pytest

from spendtrace.operators import attribution as A
from spendtrace.operators import costs as C
from spendtrace.operators import latency as L
from tests.frames import frame, history, logs, same_rows, values

LONG = "select a from t where region = 'north' and status = '{}' and amount between 10 and 5000 and day >= 1 {}"


def skewed(spark, seed=5):
    """A third of both sides shares one text; NULLs, blanks and strangers are mixed in."""
    rng = random.Random(seed)

    def text():
        x = rng.random()
        if x < 0.33:
            return "select  hot\nfrom t;"
        return rng.choice([None, "", " ; ", *(f"select {i} from t" for i in range(12))])

    requests = [
        {
            "semantic_model_name": rng.choice([None, "", "m1", "m2", "m3"]),
            "user_name": rng.choice([None, "u1", "u2", "u3"]),
            "latency_ms": rng.choice([None, *range(100, 4000, 37)]),
            "generated_sql": text(),
            "request_id": None if rng.random() < 0.05 else f"r{i}",
        }
        for i in range(120)
    ]
    executed = [
        {
            "total_elapsed_time": rng.choice([None, *range(5, 900, 11)]),
            "cleaned_query_text": (text() or "").lower(),
            "credits_attributed_compute": rng.randrange(1, 10**6) / 10**6,
            "user_name": "svc",
        }
        for i in range(90)
    ]
    return history(spark, executed), logs(spark, requests)


@pytest.mark.parametrize(
    "report",
    [
        C.total_cost_by_model,
        C.cost_breakdown_by_model,
        C.cost_summary_view,
        C.user_activity_view,
        C.cost_by_user,
        C.attributed_total,
        C.user_activity_joined,
        C.daily_usage,
        C.model_value_counts,
        C.latency_describe,
        C.mean_total_time,
    ],
)
def test_reports_equal_those_over_pairs(spark, report):
    h, l = skewed(spark)
    matched = A.match_requests(h, l)
    same_rows(report(matched), report(matched.pairs()))


def test_saved_keys_give_the_same_match(spark, folder):
    h, l = skewed(spark)
    A.with_match_keys(h, "cleaned_query_text").write.parquet(f"{folder}/h")
    A.with_match_keys(l, "generated_sql").write.parquet(f"{folder}/l")
    saved = spark.read.parquet(f"{folder}/h"), spark.read.parquet(f"{folder}/l")
    same_rows(A.attribute_requests(*saved), A.attribute_requests(h, l))
    same_rows(A.join_diagnostics(*saved), A.join_diagnostics(h, l))
    costs = C.total_cost_by_model(A.match_requests(*saved))
    text = costs._jdf.queryExecution().executedPlan().toString()
    assert "generated_sql" not in text and "cleaned_query_text" not in text


def test_saved_keys_of_other_tiers_or_repairs_are_refused(spark):
    h, l = skewed(spark)
    made = A.with_match_keys(h, "cleaned_query_text", (50,))
    with pytest.raises(ValueError, match="made with"):
        A.match_requests(made, l)
    with pytest.raises(ValueError, match="made with"):
        A.join_diagnostics(made, l)
    with pytest.raises(ValueError, match="made with"):
        A.match_requests(A.with_match_keys(h, "cleaned_query_text"), l, repairs=[("a", "b")])


def test_known_tier_gives_the_same_match(spark):
    h, l = skewed(spark)
    tier = A.matching_tier(h, l)
    assert tier == 1
    same_rows(C.total_cost_by_model(A.match_requests(h, l, known_tier=tier)), C.total_cost_by_model(A.match_requests(h, l)))
    none = h.limit(0)
    assert A.matching_tier(none, l) == 0 and A.match_requests(h, l, known_tier=0).pairs().count() == 0


def test_pairs_are_the_plain_join(spark):
    h, l = skewed(spark)
    norm = lambda t: " ".join((t or "").strip().upper().split()).rstrip(";")
    want = sorted(
        (str(q.query_id), str(r.request_id))
        for q in h.collect()
        for r in l.collect()
        if norm(q.cleaned_query_text) and norm(q.cleaned_query_text) == norm(r.generated_sql)
    )
    got = sorted((str(q), str(r)) for q, r in values(A.attribute_requests(h, l), "query_id", "request_id"))
    assert got == want and len(got) > 500


def test_tiers_are_probed_in_order_until_one_matches(spark, monkeypatch):
    h, l = skewed(spark)
    probed = []
    is_empty = type(h).isEmpty
    monkeypatch.setattr(type(h), "isEmpty", lambda df: probed.append(df) or is_empty(df))
    assert A.matching_tier(h, l) == 1 and len(probed) == 1
    # One digest per side and probe: the tier's own.
    assert probed[0]._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2
    saved = A.with_match_keys(h, "cleaned_query_text"), A.with_match_keys(l, "generated_sql")
    assert A.matching_tier(*saved) == 1
    probed.clear()
    assert A.matching_tier(h.limit(0), l) == 0 and len(probed) == 3
    only_prefix = logs(spark, [{"generated_sql": LONG[:50] + "x" * 80}])
    probed.clear()
    assert A.matching_tier(history(spark, [{"cleaned_query_text": LONG}]), only_prefix) == 3 and len(probed) == 3


def test_later_tier_only_if_earlier_is_empty(spark):
    h = history(spark, [{"cleaned_query_text": LONG.format("on", "x")}, {"cleaned_query_text": "select 1"}])
    prefix = {"generated_sql": LONG.format("on", "y")}
    assert values(A.attribute_requests(h, logs(spark, [prefix])), "match_tier", "query_id") == [(2, "q0")]
    both = logs(spark, [prefix, {"generated_sql": "select 1;"}])
    assert values(A.attribute_requests(h, both), "match_tier", "query_id") == [(1, "q1")]
    short = logs(spark, [{"generated_sql": LONG.format("of", "x")}])
    assert A.attribute_requests(h, short, (None, 100)).count() == 0
    found = A.attribute_requests(h, short).first()
    assert (found.match_tier, found.match_key) == (3, LONG.upper()[:50])


def test_no_match_at_all_is_empty(spark):
    h = history(spark, [{"cleaned_query_text": "select 1"}, {"cleaned_query_text": ""}])
    l = logs(spark, [{"generated_sql": "insert"}, {"generated_sql": ""}, {"generated_sql": None}])
    matched = A.match_requests(h, l)
    assert matched.pairs().count() == 0
    assert C.total_cost_by_model(matched).count() == 0


def test_fan_out_is_charged_each_time(spark):
    h = history(spark, [{"cleaned_query_text": "select 1"}] * 3)
    l = logs(spark, [{"generated_sql": "SELECT 1", "semantic_model_name": "m"}])
    row = C.cost_breakdown_by_model(A.match_requests(h, l)).first()
    assert (row.request_credits, row.warehouse_credits, row.query_count) == (0.201, 1.5, 3)
    seen = A.join_diagnostics(h, l).first()
    assert (seen.history_rows, seen.log_rows, seen.shared_keys, seen.matched_pairs) == (3, 1, 1, 3)
    assert seen.match_rate == 300.0


def test_repairs_bring_sides_together(spark):
    h = history(spark, [{"cleaned_query_text": "select item _name"}])
    l = logs(spark, [{"generated_sql": "select items_name"}])
    assert A.attribute_requests(h, l, (None,)).count() == 0
    assert A.attribute_requests(h, l, (None,), [(r"item\s+_name", "items_name")]).count() == 1


def test_exact_match_uses_text_as_it_stands(spark):
    h = history(spark, [{"cleaned_query_text": "select 1"}, {"cleaned_query_text": None}])
    l = logs(spark, [{"generated_sql": " select 1 "}, {"generated_sql": "SELECT 1"}, {"generated_sql": None}])
    assert values(A.attribute_requests(h, l, normalize=False), "request_id") == [("r0",)]


def test_history_selection(spark):
    qh = frame(
        spark,
        "query_id string, query_text string, query_tag string, start_time timestamp_ntz, total_elapsed_time bigint, "
        "warehouse_name string, user_name string",
        *[(f"q{i}", text, tag, when, 1, "w", "u") for i, (text, tag, when) in enumerate(_selection())],
    )
    qa = frame(spark, "query_id string, credits_attributed_compute double", ("q0", 1.0), ("q1", 0.0), ("q2", 2.0))
    inner = A.query_history_cost(qh, qa, "2024-01-30")
    assert sorted(values(inner, "query_id")) == [("q0",)]
    left = A.query_history_cost(qh, qa, "2024-01-30", text_patterns=["%my_table%"], how="left")
    assert sorted(values(left, "query_id", "credits_attributed_compute")) == [
        ("q0", 1.0), ("q1", 0.0), ("q3", 0.0), ("q4", 0.0),
    ]


def _selection():
    import datetime as dt

    now, old = dt.datetime(2024, 1, 20), dt.datetime(2023, 12, 30)
    return [
        ("a", "ai-agent", now),
        ("b", "ai-agent", now),  # no credits
        ("c", "ai-agent", old),  # too old
        ("from MY_TABLE", None, now),
        ("from myXtable", "", now),  # _ is a wildcard
        ("other", None, now),
    ]


def _latency(spark, seed=11):
    rng = random.Random(seed)
    texts = ["select hot"] * 6 + [None, "", *(f"select {i}" for i in range(8))]
    analyst = frame(
        spark,
        "timestamp timestamp_ntz, request_id string, semantic_model_name string, user_name string, "
        "analyst_latency_ms bigint, user_question string, generated_sql string, response_status_code int",
        *[
            (None, f"r{i}", "m", "u", rng.choice([None, 10, 20, 30, 40, 5000]), "q", rng.choice(texts), 200)
            for i in range(80)
        ],
    )
    executions = frame(
        spark,
        "query_id string, query_text string, execution_time_ms bigint, warehouse_name string",
        *[(f"q{i}", f"-- c\n{rng.choice(texts)}", rng.choice([None, 1, 2, 30, 900]), "w") for i in range(60)],
    )
    return analyst, executions


@pytest.mark.parametrize("n", [1, 5, 10, 400])
def test_slowest_combined_equals_sort_of_all_pairs(spark, n):
    # Executions carry a leading comment, which leaves a blank: give requests the same.
    analyst, executions = _latency(spark)
    analyst = analyst.selectExpr("* EXCEPT (generated_sql)", "concat('-- d\n', generated_sql) AS generated_sql")
    match = A.match_latency(analyst, executions)
    joined = match.pairs()
    want = sorted(
        ((-r.total_latency_sec, r.request_id, r.query_id or "") for r in joined.collect()),
    )[:n]
    got = [(-r.total_latency_sec, r.request_id, r.query_id or "") for r in L.slowest_combined(match, n).collect()]
    assert got == want


def test_latency_headline_equals_that_of_pairs(spark):
    analyst, executions = _latency(spark)
    analyst = analyst.selectExpr("* EXCEPT (generated_sql)", "concat('-- d\n', generated_sql) AS generated_sql")
    match = A.match_latency(analyst, executions)
    pdf = match.pairs().toPandas()
    row = L.combined_headline(match).first()
    assert row.joined_rows == len(pdf) and row.matched_rows == pdf.query_id.notna().sum()
    assert row.avg_generation_sec == pytest.approx(pdf.analyst_latency_sec.mean())
    assert row.avg_execution_sec == pytest.approx(pdf.execution_latency_sec.mean())
    assert row.avg_total_sec == pytest.approx(pdf.total_latency_sec.mean())
    found = pdf[pdf.query_id.notna()]
    gen, ex = found.analyst_latency_sec.sum(), found.execution_latency_sec.sum()
    parts = {r.component: r for r in L.latency_composition(match).collect()}
    assert parts["SQL Generation"].total_time_sec == pytest.approx(gen)
    assert parts["SQL Execution"].percentage == pytest.approx(ex / (gen + ex) * 100)


def test_left_join_keeps_every_request_with_text(spark):
    analyst, executions = _latency(spark)
    joined = A.join_latency(analyst, executions.limit(0))
    usable = sum(bool((r.generated_sql or "").strip()) for r in analyst.collect())
    assert joined.count() == usable and joined.filter("query_id IS NOT NULL").count() == 0
    assert {r.percentage for r in L.latency_composition(A.match_latency(analyst, executions.limit(0))).collect()} == {0.0}
