"""Named inputs of an analysis: where each relation lives and how to read it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RELATIONS = (
    "request_log_raw",
    "query_history",
    "query_attribution",
    "metering",
    "function_usage",
    "function_query_usage",
    "analyst_usage",
    "document_usage",
    "search_usage",
    "warehouse_metering",
    "agents",
    "agent_events_raw",
    "scheduled_runs",
)


@dataclass
class UsageTables:
    """Lazy access to source relations by attribute, e.g. ``tables.metering``.

    ``locations`` maps a relation to a table name or to a path (anything that
    holds a ``/``); ``frames`` overrides single relations with a DataFrame.
    """

    spark: SparkSession
    locations: Mapping[str, str] = field(default_factory=dict)
    frames: Mapping[str, DataFrame] = field(default_factory=dict)
    format: str = "parquet"
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def get(self, relation: str) -> DataFrame:
        if relation in self.frames:
            return self.frames[relation]
        if relation not in RELATIONS or relation not in self.locations:
            raise KeyError(f"no location for relation {relation!r}")
        if relation not in self._read:  # files are listed once per relation
            where = self.locations[relation]
            reader = self.spark.read.format(self.format)
            self._read[relation] = reader.load(where) if "/" in where else self.spark.table(where)
        return self._read[relation]

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            return self.get(name)
        raise AttributeError(name)
