"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsheaf import build_session
from logsheaf.plans.workload import QUERIES

HEADLINE = (
    "parse_auth_lines",
    "events_per_day",
    "pseudonymised_events",
    "session_windows",
    "sessions_job",
    "session_summary",
    "masked_documents",
    "template_ids",
    "template_drain",
    "vocabulary",
    "token_counts",
    "token_sequences",
    "decoded_sequences",
    "ingest_clean",
    "risk_ewma",
    "alert_severity",
    "alert_percentiles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()

    # session_summary builds and stores the sessions, and vocabulary the
    # vocabulary, that the queries after them read; sessions_job keeps nothing.
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
