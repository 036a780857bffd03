"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores,
BENCH_RUNS the measured repetitions. Each query is fully materialised through the
``noop`` sink; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strikeline.catalog import load
from strikeline.session import get_session

HEADLINE = [
    "bars_ohlc_hourly", "rolling_mean_min_periods", "ewm_span_and_alpha", "session_indicators", "rolling_over_raw_ticks", "lagged_daily_joins",
    "asof_backward_last_view", "asof_forward_next_signup", "nearest_strike_within_band", "barrier_race_on_events", "gamma_exposure_daily", "iv_surface_snapshot",
    "max_pain_by_payout", "implied_vol_round_trip", "strategy_auc_table", "skip_rate_sweep", "threshold_sweep", "non_overlapping_picks", "quantile_outliers",
    "chain_rule_audit", "decision_state", "spine", "outcomes", "entry_labels", "training_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark.sparkContext.setLogLevel("ERROR")
    registry, times = load(), {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
