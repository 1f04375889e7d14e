import datetime as dt
import uuid

import pytest

from spendtrace.operators.attribution import query_history_cost
from spendtrace.sources import sinks as K
from spendtrace.schemas import REQUEST_LOG
from tests.frames import T0, frame, logs, values


@pytest.fixture
def table():
    return f"t_{uuid.uuid4().hex[:12]}"


def stored(spark, table):
    return sorted(values(spark.table(table), "request_id", "semantic_model_name"), key=repr)


def test_create_if_absent(spark, table):
    assert not K.table_exists(spark, table)
    K.ensure_log_table(spark, table)
    K.ensure_log_table(spark, table)
    assert K.table_exists(spark, table)
    assert [(f.name, f.dataType) for f in spark.table(table).schema][:17] == [
        (f.name, f.dataType) for f in REQUEST_LOG
    ]


def test_append_adds_each_request_once(spark, table):
    first = logs(spark, [{"semantic_model_name": "m"}, {"semantic_model_name": None}, {"semantic_model_name": ""}])
    K.append_logs(first, table)
    assert stored(spark, table) == [("r0", "m"), ("r2", "")]
    K.append_logs(first, table)
    assert spark.table(table).count() == 2
    later = {"semantic_model_name": "m", "request_id": "r9", "timestamp": T0 + dt.timedelta(days=3)}
    K.append_logs(logs(spark, [later, later, {"semantic_model_name": "m"}]), table)
    assert stored(spark, table) == [("r0", "m"), ("r2", ""), ("r9", "m")]


def test_append_keeps_rows_without_id_or_time(spark, table):
    odd = [{"semantic_model_name": "m", "request_id": None}] * 2 + [{"semantic_model_name": "m", "timestamp": None}]
    K.append_logs(logs(spark, odd), table)
    K.append_logs(logs(spark, odd[2:]), table, dedupe_on="request_id")
    assert spark.table(table).count() == 4  # the last one is r2 first and r0 then
    K.append_logs(logs(spark, odd[2:]), table)
    assert spark.table(table).count() == 4


def test_append_without_dedupe_repeats(spark, table):
    one = logs(spark, [{"semantic_model_name": "m"}])
    K.append_logs(one, table, dedupe_on=None)
    K.append_logs(one, table, dedupe_on=None)
    assert spark.table(table).count() == 2


def test_load_replaces_all_days(spark, table):
    K.load_logs(logs(spark, [{"timestamp": T0 + dt.timedelta(days=d)} for d in range(3)]), table)
    assert spark.table(table).count() == 3
    K.load_logs(logs(spark, [{"request_id": "new"}]), table)
    assert stored(spark, table) == [("new", None)]
    K.load_logs(logs(spark, [{"request_id": "more"}]), table, mode="append")
    assert spark.table(table).count() == 2
    with pytest.raises(ValueError):
        K.load_logs(logs(spark, []), table, mode="merge")


def _history(spark, *ids):
    qh = frame(
        spark,
        "query_id string, query_text string, query_tag string, start_time timestamp_ntz, total_elapsed_time bigint, "
        "warehouse_name string, user_name string",
        *[(i, f"select {i}", "ai-agent", T0, 1, "w", "u") for i in ids],
    )
    return qh, frame(spark, "query_id string, credits_attributed_compute double", *[(i, 1.0) for i in ids])


def test_history_modes(spark, table):
    ids = lambda: sorted(r[0] for r in values(spark.table(table), "query_id"))
    assert K.build_query_history(*_history(spark, "a"), table, "2024-01-30")
    assert not K.build_query_history(*_history(spark, "b"), table, "2024-01-30")
    assert ids() == ["a"]
    assert K.build_query_history(*_history(spark, "b", "c"), table, "2024-01-30", mode="refresh")
    assert ids() == ["b", "c"]
    assert K.build_query_history(*_history(spark, "d"), table, "2024-01-30", mode="refresh", how="left")
    assert ids() == ["d"] and "query_tag" in spark.table(table).columns  # recreated
    assert K.build_query_history(*_history(spark, "e"), table, "2024-01-30", mode="replace")
    assert spark.table(table).columns == query_history_cost(*_history(spark, "e"), "2024-01-30").columns
    with pytest.raises(ValueError):
        K.build_query_history(*_history(spark, "f"), table, "2024-01-30", mode="other")


def test_row_counts(spark):
    counts = K.table_row_counts({"a": spark.range(3), "b": spark.range(0)})
    assert sorted(values(counts)) == [("a", 3), ("b", 0)]
