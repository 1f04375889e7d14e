"""SparkSession with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE coalesces small shuffles, splits skewed join partitions and turns a join
# into a broadcast only when the measured size is under the threshold.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "spendtrace", master: str | None = None, **conf: str) -> SparkSession:
    """Session with :data:`DEFAULTS`; explicit ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``fallback`` is used only where the cluster names none, and is not recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is unset; pass a shared folder")
    return fallback
