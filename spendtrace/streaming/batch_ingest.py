"""Incremental load of raw requests, each micro-batch exactly once.

The table's partitions are named by day and by the batch that brought them, and a
batch overwrites its own partitions: repeated after a failure it puts the same rows in
the same place, those without request id too. Requests with an id are
also compared with the other batches' rows of the days they belong to, so
what the source sends again adds nothing, under whatever query it comes. A session that
has read the table before sees a repeated batch's new files after ``spark.catalog.refreshTable``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendtrace.schemas import REQUEST_LOG
from spendtrace.sources.extract import extract_request_log
from spendtrace.sources.sinks import LOG_DATE, new_logs

BATCH = "ingest_batch"


def ensure_batch_table(spark: SparkSession, table: str) -> None:
    """Create the request log by day and batch unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REQUEST_LOG)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {LOG_DATE} DATE, {BATCH} STRING) "
        f"USING parquet PARTITIONED BY ({LOG_DATE}, {BATCH})"
    )


def write_batch(
    requests: DataFrame,
    table: str,
    batch: str,
    staged: str,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Put the requests that name a semantic model under ``batch``, in place of what it held on their days.

    They are extracted already, or raw and come with ``extract`` (see ``sinks.new_logs``). They are written to the folder ``staged`` first, as the table is both read and written.
    """
    spark = requests.sparkSession
    rows = requests.filter(F.col("semantic_model_name").isNotNull())
    others = spark.table(table).filter(F.col(BATCH) != batch)
    fresh = new_logs(rows, others, extract=extract).withColumn(BATCH, F.lit(batch))
    fresh.hint("rebalance", LOG_DATE).write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(fresh.schema).parquet(staged)
    mode, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(mode, "dynamic")  # the writer's option does not reach insertInto
    try:
        fresh.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def ingest_batches(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Load a stream of raw requests into ``table``; batches are named by the query's id, which its checkpoint keeps, and number."""
    ensure_batch_table(stream.sparkSession, table)

    def step(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the streaming query's id is unknown, so its batches cannot be told from another's")
        # One staging folder a query: each batch overwrites the one before.
        name, staged = f"{query}-{batch_id:012d}", f"{checkpoint.rstrip('/')}-staged"
        write_batch(batch, table, name, staged, extract_request_log)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
