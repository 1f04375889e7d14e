"""Tables the library keeps: processed request log and query history with cost."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.functions import exprs as X
from spendtrace.operators.attribution import query_history_cost
from spendtrace.schemas import REQUEST_LOG
from spendtrace.sources.snapshots import publish

# The log table is partitioned by day, so appends and windows touch few files.
LOG_DATE = "log_date"
_NO_DATE = "1970-01-01"


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per named frame."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def ensure_log_table(spark: SparkSession, table: str) -> None:
    """Create the processed log table unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REQUEST_LOG)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {LOG_DATE} DATE) "
        f"USING parquet PARTITIONED BY ({LOG_DATE})"
    )


def _log_date() -> Column:
    return F.coalesce(X.day("timestamp"), F.lit(_NO_DATE).cast("date")).alias(LOG_DATE)


def dated(logs: DataFrame) -> DataFrame:
    """The table's columns; a request without timestamp goes to 1970-01-01."""
    return logs.select(*[F.col(f.name).cast(f.dataType) for f in REQUEST_LOG], _log_date())


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "request_id") -> DataFrame:
    """Rows whose (key, day) is neither stored nor repeated among ``rows``; NULL keys all stay.

    A request is known by its key and its day: sent again with another day, it
    is another row, however the rows were batched. The first and last day of
    ``rows`` (one row, from the time column alone) are literals of the stored
    table's scan, so it reads only the partitions between them, and that of
    requests without time. One shuffle serves both tests; rows without key are
    spread by a number of their own. The stored keys grow with the table and are never broadcast.
    """
    undated = F.col(LOG_DATE) == F.lit(_NO_DATE).cast("date")
    span = rows.filter(~undated).agg(F.min(LOG_DATE).alias("first"), F.max(LOG_DATE).alias("last")).first()
    reached = undated if span["first"] is None else undated | F.col(LOG_DATE).between(span["first"], span["last"])
    spread = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(key))
    same = [key, LOG_DATE, "_spread"]
    firsts = rows.withColumn("_spread", spread).dropDuplicates(same)
    known = stored.filter(reached).select(key, LOG_DATE, F.xxhash64(key).alias("_spread"))
    return firsts.join(known.hint("merge"), same, "left_anti").select(rows.columns)


def new_logs(
    requests: DataFrame, stored: DataFrame, key: str = "request_id", extract: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The table's rows of the requests that :func:`new_rows` finds new.

    Raw requests come with ``extract``: only new ones are parsed, by all tasks of the shuffle by key,
    however few files (and so tasks) brought them.
    """
    if extract is None:
        return new_rows(dated(requests), stored, key)
    rows = requests.withColumns({key: F.col(key).cast(REQUEST_LOG[key].dataType), LOG_DATE: _log_date()})
    return dated(extract(new_rows(rows, stored, key)))


def append_logs(
    logs: DataFrame,
    table: str,
    dedupe_on: str | None = "request_id",
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append requests that name a semantic model.

    With ``dedupe_on`` a second run adds nothing; ``None`` appends everything again.
    Raw requests come with ``extract`` (see :func:`new_logs`).
    """
    spark = logs.sparkSession
    ensure_log_table(spark, table)
    rows = logs.filter(F.col("semantic_model_name").isNotNull())
    if dedupe_on:
        rows = new_logs(rows, spark.table(table), dedupe_on, extract)
    else:
        rows = dated(extract(rows) if extract else rows)
    _balanced(rows).write.insertInto(table)


def load_logs(logs: DataFrame, table: str, mode: str = "overwrite") -> None:
    """Replace the table's content (``overwrite``) or add to it (``append``)."""
    if mode == "append":
        ensure_log_table(logs.sparkSession, table)
        _balanced(dated(logs)).write.insertInto(table)
    elif mode == "overwrite":
        writer = _balanced(dated(logs)).write.format("parquet").mode("overwrite")
        writer.option("partitionOverwriteMode", "static").partitionBy(LOG_DATE).saveAsTable(table)
    else:
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")


def _balanced(rows: DataFrame) -> DataFrame:
    """Few files per day, with a busy day split over several tasks by AQE."""
    return rows.hint("rebalance", LOG_DATE)


def build_query_history(
    query_history: DataFrame,
    query_attribution: DataFrame,
    table: str,
    as_of: X.Moment,
    mode: str = "create",
    **selection,
) -> bool:
    """Save query history with cost; returns whether the table was written.

    ``create`` leaves an existing table alone; ``refresh`` and ``replace`` publish
    a whole new version, with whatever columns it has, so readers and failures meet
    the old rows or the new.
    """
    if mode not in ("create", "refresh", "replace"):
        raise ValueError(f"mode must be create, refresh or replace, not {mode!r}")
    if table_exists(query_history.sparkSession, table) and mode == "create":
        return False
    publish(query_history_cost(query_history, query_attribution, as_of, **selection), table)
    return True
