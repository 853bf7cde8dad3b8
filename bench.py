"""Wall-clock of the registered queries.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores;
``BENCH_QUERIES`` (comma-separated) restricts the run. Each query is built and
run to a sink that reads every row and column; the JSON line holds the first
run of each query, after one small query has started the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textwarden.plans import catalogue  # noqa: E402
from textwarden.session import local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    todo = catalogue.queries()
    spark = local_session(cpus, app="textwarden-bench")
    run(todo["event_summary"](spark, sf))
    times, failed = {}, {}
    for name in names or todo:
        start = time.perf_counter()
        try:
            run(todo[name](spark, sf))
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # noqa: BLE001 - one query must not hide the others
            failed[name] = str(exc).splitlines()[0][:200]
        print(f"{name} {times.get(name, 'FAILED')}", file=sys.stderr, flush=True)
    out = {
        "metric": "total wall-clock of registered queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
        "cpus": cpus,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
