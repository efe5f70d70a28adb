"""Headline timings; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8), BENCH_RUNS (3).
Each query is run once to warm up and then BENCH_RUNS times; the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidepane import AVG, MAX, MIN, RANGE, STD, SUM, WindowSpec  # noqa: E402
from tidepane.operators import (  # noqa: E402
    accepted, current_windows, final_windows, window_versions, with_progress,
)
from tidepane.plans.catalog import SPEC, load  # noqa: E402
from tidepane.plans.native import native_windows  # noqa: E402
from tidepane.plans.sliding import sliding_current, sliding_panes, sliding_versions  # noqa: E402

SIX = [MIN, MAX, SUM, AVG, STD, RANGE]
LONG = WindowSpec.of("320 min", "2 min", "24 min")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidepane-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    rows = load(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    keyed = load(spark, sf_dir, ["event_type"]).withColumn("value", F.col("value").cast("double"))
    count = rows.count()
    panes = {spec: sliding_panes(rows, spec, SIX) for spec in (SPEC, LONG)}

    def native(spec):
        kept = accepted(with_progress(rows, spec), spec)
        return native_windows(kept.withColumn("ts", F.timestamp_millis("ts_ms")), spec, SIX)

    queries = {
        "progress": lambda: with_progress(rows, SPEC),
        "panes": lambda: sliding_panes(rows, SPEC, SIX),
        **{f"current_{a.name}": lambda a=a: sliding_current(rows, SPEC, [a]) for a in SIX},
        "versions_all_six": lambda: sliding_versions(rows, SPEC, SIX),
        "versions_keyed": lambda: sliding_versions(keyed, SPEC, [SUM], ["event_type"]),
        "versions_long_window": lambda: sliding_versions(rows, LONG, SIX),
        "panes_to_current_16": lambda: current_windows(panes[SPEC], SPEC, SIX),
        "panes_to_current_160": lambda: current_windows(panes[LONG], LONG, SIX),
        "panes_to_versions_16": lambda: window_versions(panes[SPEC], SPEC, SIX),
        "panes_to_final_16": lambda: final_windows(panes[SPEC], SPEC, SIX),
        "panes_to_final_160": lambda: final_windows(panes[LONG], LONG, SIX),
        "native_window_16": lambda: native(SPEC),
        "native_window_160": lambda: native(LONG),
    }
    wanted = os.environ.get("BENCH_QUERIES")
    if wanted:
        queries = {name: queries[name] for name in wanted.split(",")}
    times = {}
    for name, query in queries.items():
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "sliding_window_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": count,
        "rows_per_sec": {name: round(count / sec) for name, sec in times.items()},
        "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
