"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from netquarry.plans import registry

HEADLINE = (
    "conflict_summary", "frequency_patterns", "class_weights", "split_leakage", "column_moments", "column_quantiles", "correlation_pairs", "group_summary",
    "class_metrics", "ranking_metrics", "mann_whitney", "kruskal_wallis", "idle_sessions", "flow_sessions", "flow_features", "bound_flows", "domain_features",
)


def main() -> None:
    at, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.FLAGSHIP(spark, at).count()  # starts the session's machinery
    queries = registry.queries()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, at).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(at.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
