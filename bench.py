"""Benchmark: run the registered queries on one scale factor and print ONE JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_REPEAT`` (default 3), ``BENCH_ALL`` (1 = every registered
query repeated, 0 = headline queries repeated and the rest timed once).

Each query is executed in full with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver). Headline queries get one warm-up run and
the median of ``BENCH_REPEAT`` timed runs. ``value`` is the sum of the
headline medians in seconds, every query starting from the raw parquet
tables. ``silver_mode`` (``BENCH_SILVER=1``, default) also reports the one-off
materialisation of the relations and the headline queries over it.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def run_once(fn, spark, sf_dir) -> float:
    t = time.perf_counter()
    df = fn(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    every = os.environ.get("BENCH_ALL", "0") == "1"

    from fieldpulse.plans.registry import REGISTRY
    from fieldpulse.session import build_session

    spark = build_session(f"local[{cpus}]", app_name="fieldpulse-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    items = REGISTRY.items()
    callables = REGISTRY.callables()
    headline = [n for n, q in items.items() if q.headline or every]
    others = [n for n in items if n not in headline]

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in headline:
        fn = callables[name]
        try:
            run_once(fn, spark, sf_dir)  # warm-up
            times[name] = round(statistics.median(run_once(fn, spark, sf_dir) for _ in range(repeat)), 4)
        except Exception as exc:  # keep benchmarking the rest
            errors[name] = repr(exc)[:300]
    other_times: dict[str, float] = {}
    for name in others:
        try:
            other_times[name] = round(run_once(callables[name], spark, sf_dir), 4)
        except Exception as exc:
            errors[name] = repr(exc)[:300]

    # Silver mode: the relations are written once (bucketed by activity id,
    # like an ingest step), then every query reads the written tables.
    silver_times: dict[str, float] = {}
    if os.environ.get("BENCH_SILVER", "1") == "1":
        from fieldpulse.session import shared_dir
        from fieldpulse.sources.adapter import Workspace

        t = time.perf_counter()
        silver = Workspace(spark, sf_dir).materialize(shared_dir(spark, "bench-silver"), buckets=cpus * 2,
                                                     prefix="bench")
        silver_times["materialize"] = round(time.perf_counter() - t, 4)
        for name in headline:
            if name == "st01_02_stream_refresh":
                continue
            build = items[name].build
            try:
                build(silver).write.format("noop").mode("overwrite").save()
                ts = []
                for _ in range(repeat):
                    t = time.perf_counter()
                    build(silver).write.format("noop").mode("overwrite").save()
                    ts.append(time.perf_counter() - t)
                silver_times[name] = round(statistics.median(ts), 4)
            except Exception as exc:
                errors[f"silver:{name}"] = repr(exc)[:300]

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "other_queries_single_run": other_times,
        "silver_mode": silver_times,
        "all_queries_total_sec": round(sum(times.values()) + sum(other_times.values()), 4),
        "n_queries": len(times) + len(other_times),
        "errors": errors,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
