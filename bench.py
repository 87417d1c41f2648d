"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from marketloom.plans.catalog import QUERIES
from marketloom.session import local_session

HEADLINES = [
    "exec_daily_summary", "geo_sales", "scorecard", "rule_errors", "dedupe_latest", "merge_fact", "fact_star_lookup", "abc_xyz_by_origin",
    "inventory_health", "reorder_alerts", "dense_daily_demand", "ts_features", "feature_store", "metrics_by_fold", "forecast_vs_actual",
    "drift_features", "stock_ledger", "latency_quantiles", "stream_snapshot_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        started = time.time()
        # The whole result is computed and discarded on the executors.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
