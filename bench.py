"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores. Each
query runs once to warm up and three times for the median. With ``--detail``
each query's jobs, shuffled bytes and slowest task go to standard error.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fleetspectra.session import local_session
from registry.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINES = [
    "cohort_signals",
    "clean_signals",
    "gear_shift_events",
    "time_since_last",
    "spectra_1d_time",
    "spectra_1d_distance",
    "spectra_2d_distance",
    "spectra_all_configs",
    "translate_spectra",
    "complete_spectra",
    "normalize_spectra",
    "vehicle_stats",
    "iqr_bounds",
    "outlier_vins",
    "remove_outliers",
    "zero_mass_outliers",
    "fleet_average_by_group",
    "fleet_before_after",
    "weighted_fleet_average",
    "box_stats",
    "value_quantiles",
    "prepare_signals",
    "weight_matrix",
    "vehicle_vs_fleet",
    "save_and_reload",
]


def run(spark, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def stage_totals(spark, jobs_before: set[int]) -> dict[str, int]:
    """Jobs and shuffled bytes since ``jobs_before``, from Spark's own store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    new = [jobs.apply(i) for i in range(jobs.size()) if jobs.apply(i).jobId() not in jobs_before]
    stages = {job.stageIds().apply(k) for job in new for k in range(job.stageIds().size())}
    written = 0
    for stage in stages:
        try:
            written += store.lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # a skipped stage leaves no record
            continue
    return {"jobs": len(new), "shuffle_bytes": int(written)}


def job_ids(spark) -> set[int]:
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    return {jobs.apply(i).jobId() for i in range(jobs.size())}


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = [a for a in sys.argv[1:] if not a.startswith("-")] or HEADLINES
    times = {}
    for name in names:
        run(spark, name)
        before = job_ids(spark) if "--detail" in sys.argv else set()
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        if "--detail" in sys.argv:
            totals = stage_totals(spark, before)
            per_run = {k: v // RUNS for k, v in totals.items()}
            print(name, times[name], per_run, file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = float(os.path.basename(SF.rstrip("/")).removeprefix("sf") or 0)
    print(
        json.dumps(
            {"metric": "total_warm_median", "value": total, "unit": "sec", "queries": times, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
