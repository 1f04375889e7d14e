"""Wall time of the headline queries; prints one JSON line.

The bound relations are stored once, untimed, as an installation has them:
split files per relation. Each query then runs twice in full (every output row
is computed) and the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

from checks.bindings import BoundTables
from checks.queries import BUILDERS
from spendtrace.session import build_session, shared_dir
from spendtrace.sources.tables import RELATIONS, UsageTables

HEADLINE = [
    "request_log_extract",
    "verified_query_count",
    "top_verified_queries",
    "slowest_queries",
    "latency_summary",
    "user_activity",
    "model_usage_summary",
    "query_history_cost",
    "attribute_requests",
    "join_diagnostics",
    "total_cost_by_model",
    "cost_breakdown_by_model",
    "cost_by_agent",
    "cost_summary_view",
    "user_activity_view",
    "latency_describe",
    "credits_by_model",
    "credits_by_warehouse",
    "service_overview",
    "gen_breakdown",
    "warehouse_distribution",
    "join_latency",
    "combined_headline",
    "slowest_combined",
    "price_tokens_si",
    "agent_cost_by_agent",
    "agent_cost_detail",
    "agent_combined",
    "budget_alert_month",
    "budget_tiers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored = f"{shared_dir(spark, tempfile.mkdtemp(prefix='run-', dir='/tmp'))}/bench-{uuid.uuid4().hex}"
    bound = BoundTables(spark, sf_dir)
    for relation in RELATIONS:
        bound.get(relation).repartition(cpus).write.parquet(f"{stored}/{relation}")
    tables = UsageTables(spark, {r: f"{stored}/{r}" for r in RELATIONS})
    seconds = {}
    for name in names:
        build, _ = BUILDERS[name]
        times = []
        for _ in range(2):
            began = time.perf_counter()
            build(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
