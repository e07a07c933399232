"""Bench: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then three timed runs; the median is reported.
Runs execute the whole plan from the parquet files on (nothing is cached) through the
``noop`` sink (nothing is collected).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_spark  # noqa: E402
from tessera.sources.fixtures import register_tables  # noqa: E402

# group cosine, top-k for many queries, forecasts for all hotspots.
BENCH = ["c13_map_points", "f11_country_year_totals", "r6_country_risk", "g3_hotspot_summary",
         "n3_pairwise_cosine", "q5_similar_incidents", "f7_arima_forecast_intervals"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark()
    register_tables(spark, sf_dir)
    reg = load_all()
    times: dict[str, float] = {}
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    for name in (only or BENCH):
        build = reg[name].build
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
