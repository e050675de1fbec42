"""Time all queries of the engine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores. Every query writes its whole result to the ``noop`` sink, so nothing is pruned
and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusward.session import build_session
from workload import registry

# One query of each kind of pass, run once before anything is timed.
WARM_UP = ("line_rule_counts", "policy_findings", "run_progress", "stream_window_counts", "duplicate_blocks")


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        spark = build_session("bench", cores, cores, shared)
        for name in WARM_UP:
            run(spark, name, sf_dir)
        times = {name: round(run(spark, name, sf_dir), 3) for name in registry.QUERIES}
        spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
