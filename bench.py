"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line.  ``value`` is the sum of the headline query times.  Each
query runs to completion through the ``noop`` sink, which computes every output
column; nothing is collected to the driver.  The one-time writes of the role
tables (raw batch rows, their batch CSV files, then the ETL's legs and
trips) are timed separately
under ``setup`` and are not part of ``value``; the ETL itself is measured by the
``clean_legs`` and ``build_trips`` queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from transitreach.catalog import roles as R  # noqa: E402
from transitreach.catalog.registry import QUERIES, batch_folder  # noqa: E402
from transitreach.session import get_session  # noqa: E402

HEADLINE = (
    "load_batches",
    "clean_legs",
    "build_trips",
    "batch_coverage",
    "error_pairs",
    "od_stats",
    "accessibility_selected",
    "accessibility_run",
    "cutoff_sweep",
    "cutoff_union",
    "line_chart_feed",
    "agency_chart_feed",
    "census_join",
    "scatter_feed",
    "schools_table",
    "table_page",
    "flatten_responses",
    "request_plan",
)


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or list(HEADLINE)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="transitreach-bench")

    setup = {}
    for name, build in (("raw", R.raw), ("batch_csv", batch_folder), ("legs", R.legs),
                        ("trips", R.trips), ("trips_full", R.trips_full), ("responses", R.responses)):
        t0 = time.time()
        build(spark, sf_dir)
        setup[name] = round(time.time() - t0, 3)

    times, errors = {}, {}
    for key in keys:
        fn, _sql = QUERIES[key]
        t0 = time.time()
        try:
            run_noop(fn(spark, sf_dir))
        except Exception as exc:  # noqa: BLE001 -- report the failure, keep measuring the rest
            errors[key] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        times[key] = round(time.time() - t0, 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "setup": setup,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
