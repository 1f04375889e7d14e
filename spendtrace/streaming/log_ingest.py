"""Incremental load of raw requests into the processed log table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendtrace.sources.extract import extract_request_log
from spendtrace.sources.sinks import append_logs, ensure_log_table


def ingest_logs(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    watermark: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append new requests once each, whatever the source repeats.

    By default repeats are found against the stored days they belong to, so
    late requests are kept however late they are. With a ``watermark`` (for
    example "1 hour") repeats within it are dropped in the stream already,
    which also drops requests that arrive later than that.
    """
    ensure_log_table(stream.sparkSession, table)
    if watermark:
        timed = stream.withColumns(
            {
                "_at": F.col("timestamp").cast("timestamp"),
                "_id": F.coalesce("request_id", F.expr("uuid()")),
            }
        )
        stream = timed.withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["_id"])

    def step(batch: DataFrame, _batch_id: int) -> None:
        append_logs(batch, table, extract=extract_request_log)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
