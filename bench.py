"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full result is produced (``noop`` sink: every row computed, none
collected), each query in its own process. Timing protocol as the
reference's: one warm-up run, then
$BENCH_REPS (default 3) timed runs, the median is reported. Stage tables are
dropped before every run, so each timing includes everything the query
derives from the raw tables.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # the workload: star queries over the fact table
    "J1_star_join3_grouped",
    "A1_star_global_aggregate",
    "A3_star_window_grouped",
    "O3_star_top_k_100",
    "W1_star_ranked_rows",
    # the log: shape extraction, calibration, priors
    "X14_table_sizes",
    "C02_calibrated_runtime",
    "A06_prior_from_earlier_batches",
    # the flagship: versions, detail, SLA verdicts
    "K02_sla_verdicts",
]


def time_one(name: str, sf_dir: str, cpus: int) -> float:
    """Warm-up run, then the median of $BENCH_REPS timed runs of one query."""
    from shapecast.plans.registry import load_all
    from shapecast.session import get_spark, reset_stages
    spark = get_spark(f"local[{cpus}]", max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    builder = load_all()[name][0]
    reps = int(os.environ.get("BENCH_REPS", "3"))

    def run():
        reset_stages()
        gc.collect()        # drop the previous run's DataFrames (see session.py cleaner)
        time.sleep(1)
        t0 = time.perf_counter()
        builder(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run()                                          # warm-up
    runs = sorted(run() for _ in range(reps))
    print(f"[bench] {name} {runs[len(runs) // 2]:.3f} s (runs {[round(r, 2) for r in runs]})",
          file=sys.stderr, flush=True)
    spark.stop()
    return runs[len(runs) // 2]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    if len(sys.argv) == 3 and sys.argv[1] == "--one":
        print(json.dumps({"value": time_one(sys.argv[2], sf_dir, cpus)}))
        return
    # Each query runs in its own process (its own JVM): state one query leaves
    # behind (checkpointed stages, shuffle files, heap) is not billed to the
    # next. JVM start-up stays outside the timings (warm-up run first).
    import subprocess
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        out = subprocess.run([sys.executable, os.path.abspath(__file__), "--one", name],
                             capture_output=True, text=True, timeout=3600)
        sys.stderr.write("".join(l + "\n" for l in out.stderr.splitlines()
                                 if l.startswith("[bench]")))
        lines = [l for l in out.stdout.splitlines() if l.startswith("{")]
        if out.returncode != 0 or not lines:
            raise SystemExit(f"bench query {name} failed:\n{out.stderr[-2000:]}")
        timings[name] = round(json.loads(lines[-1])["value"], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
