"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Per query: one warm-up run, then the median of ``$BENCH_REPEAT`` (default 3) runs
that compute and count every result column through the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from edurank.plans.materialize import drop_intermediate
from edurank.workload.catalog import REGISTRY, run

QUERIES = (
    "rate_default",
    "rate_subjects_enforced",
    "rate_program_scope",
    "program_school_match",
    "search_everything",
    "search_profiles_paged",
    "school_cards",
    "subject_heat",
    "subject_compare",
    "dup_groups",
    "merge_map",
    "exam_long_rows",
    "exam_aggregate",
    "integrity_violations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or QUERIES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("edurank-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        assert name in REGISTRY, name
        times = []
        for attempt in range(repeat + 1):
            start = time.perf_counter()
            run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    drop_intermediate(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
