"""Small hand-made relations."""

import datetime as dt

from pyspark.sql import types as T

from spendtrace.schemas import REQUEST_LOG

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)

HISTORY = (
    "query_id string, query_text string, start_time timestamp_ntz, total_elapsed_time bigint, "
    "warehouse_name string, user_name string, credits_attributed_compute double, cleaned_query_text string"
)


def logs(spark, rows):
    """Request-log rows from dicts; what is not given is NULL (credits default to the flat price)."""
    full = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(REQUEST_LOG.names)
        base.update(
            request_id=f"r{i}", timestamp=T0, query_type="Non-Verified Query", request_credits=0.067
        )
        base.update(row)
        full.append(tuple(base[n] for n in REQUEST_LOG.names))
    return spark.createDataFrame(full, REQUEST_LOG)


def history(spark, rows):
    names = [f.split()[0] for f in HISTORY.split(", ")]
    full = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(names)
        base.update(query_id=f"q{i}", start_time=T0, warehouse_name="WH", credits_attributed_compute=0.5)
        base.update(row)
        full.append(tuple(base[n] for n in names))
    return spark.createDataFrame(full, HISTORY)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *columns):
    return [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]


def same_rows(a, b):
    """Both frames hold the same rows, floats compared to nine digits."""

    def plain(df):
        cols = sorted(df.columns)
        cell = lambda v: f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else v
        return sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)

    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)


NTZ = T.TimestampNTZType()
