"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default all). Every query is run to its last
row and column into a sink that stores nothing. ``prepare_tables`` is the one-off
preparation that the later queries read.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimscope.plans.queries import QUERIES  # noqa: E402
from claimscope.plans.tables import prepared  # noqa: E402
from claimscope.session import local_session  # noqa: E402


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="bench")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)

    run_all(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    start = time.perf_counter()
    for which in ("all", "batch", "history"):
        prepared(spark, sf_dir, which)
    times = {"prepare_tables": round(time.perf_counter() - start, 3)}
    for name in names:
        start = time.perf_counter()
        run_all(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
