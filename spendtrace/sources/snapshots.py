"""Whole tables replaced at once: versions, and a view that points to the newest.

A version is a table of its own, written in full before the view is moved in one
catalog operation. A reader sees the old rows or the new, never part of them, and a write
that fails leaves the view as it was. A few older versions stay for
readers that began on them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_VERSION = "__version_"


def versions(spark: SparkSession, name: str) -> list[str]:
    """Tables behind the view ``name``, oldest first."""
    *database, own = name.split(".")
    where = f" IN {'.'.join(database)}" if database else ""
    # A prefix match: the underscore is a literal here, the asterisk any text.
    found = spark.sql(f"SHOW TABLES{where} LIKE '{own}{_VERSION}*'").collect()
    return sorted(".".join([*database, r["tableName"]]) for r in found)


def is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "VIEW"


def publish(rows: DataFrame, name: str, keep: int = 2) -> str:
    """Write ``rows`` as a new version, point ``name`` to it, and drop all but the ``keep`` newest; returns the version.

    A plain table of that name becomes the version before: it is renamed only after the new one is whole.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    spark = rows.sparkSession
    version = f"{name}{_VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    rows.write.format("parquet").saveAsTable(version)
    if spark.catalog.tableExists(name) and not is_view(spark, name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{_VERSION}{0:020d}_{uuid.uuid4().hex[:8]}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in versions(spark, name)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return version


def roll_back(spark: SparkSession, name: str) -> str:
    """Point ``name`` to the version before its newest, and drop the newest; returns the version now shown."""
    found = versions(spark, name)
    if len(found) < 2:
        raise ValueError(f"{name} has no earlier version")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {found[-2]}")
    spark.sql(f"DROP TABLE IF EXISTS {found[-1]}")
    return found[-2]
