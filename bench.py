"""Time the headline queries and print one JSON line.

Every query reads its tables from parquet and writes its full result to the noop sink.
A first untimed pass compiles the plans; the second one is reported.
"""

from __future__ import annotations

import json
import os
import time

from contract.queries import queries
from daytide.session import local_session

HEADLINE = [
    "event_filter",
    "daily_base_lineitem",
    "user_day_features",
    "user_day_features_orders",
    "normalize_stats",
    "z_features",
    "feature_summary",
    "daily_summary",
    "correlation_long",
    "hist_clipped",
    "ratio_scatter",
    "labelled_user_days",
    "state_profile",
    "hmm_decode",
    "hmm_states",
]


def timed(query, spark, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "daytide-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        timed(registered[name], spark, sf_dir)
        seconds[name] = round(timed(registered[name], spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
