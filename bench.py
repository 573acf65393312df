"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from servescope.plans import catalog  # noqa: E402
from servescope.session import local_session  # noqa: E402

HEADLINE = (
    "run_summary_v2", "run_summary_v1", "latency_percentiles", "max_concurrency_interval",
    "request_event_consistency", "metric_deltas", "semantic_fingerprint", "sse_frames",
    "completion_replay", "counter_deltas", "log_correlation", "asof_scrape", "cancellation_class",
    "secret_findings", "bundle_audit", "sequence_gaps", "rules_request_v2",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    # start the JVM's code paths on the smallest tables, so the first query is not charged for them
    small = str(Path(folder).parent / "sf0.001")
    if Path(small).is_dir():
        catalog.QUERIES["latency_percentiles"](spark, small).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
