"""Headline queries timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is planned and fully executed into the no-op sink; the first query
is run once before timing to start the JVM and its compiler.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hourmark.plans import ENTRIES
from hourmark.session import build_session

HEADLINE = [
    "flagship_persistence_scores", "a02_parquet_scan", "b01_calendar_features", "b10_solar_position", "c05_coarse_steps", "c09_series_contract",
    "d02_declared_cardinality", "d04_hour_lags", "d06_asof_run", "d07_asof_per_location", "d11_previous_curve", "e01_resample_hourly",
    "e13_site_descriptives", "e17_metrics_over_sets", "e35_upper_tail_mean", "f03_last_active_lags", "f05_week_index", "f08_latest_per_key",
    "h01_horizon_fanout", "i02_seasonal_folds", "j03_three_target_bootstrap", "j08_copula_sampling", "j09_conformal_fit", "j12_scenario_evaluation",
    "k01_merit_order_plan", "k09_strategy_ladder", "dataset_canonical_hourly", "dataset_intraday_features",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g", "spark.driver.host": "localhost",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    ENTRIES[names[0]].run(spark, path).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
