"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from reliefgrid.plans import queries  # noqa: E402
from reliefgrid.session import build_session  # noqa: E402

HEADLINE = [
    "bottleneck_diagnosis", "state_rollup", "national_baseline", "seasonal_index", "proportional_allocation", "rank_scores",
    "state_baseline", "market_matrix", "search_index", "dedup_first", "within_radius", "nearest_point", "corridor", "match_top3",
    "attribution_long", "whatif_scenarios", "zone_alerts", "watch_zones", "lag_features", "month_elasticity", "risk_ranking",
    "ridge_forecast", "impact_scenarios", "category_split", "multipliers_iterated", "congestion_profile", "trailing_mean",
    "occupancy_lines", "origin_destination", "quality_violations", "stream_daily_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g"
    )
    plans, took = queries(), {}
    # one small read starts the executors before anything is timed
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
