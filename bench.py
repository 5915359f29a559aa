"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads).
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from cargoscope.catalog import queries
from cargoscope.session import local_session

HEADLINE = [
    "txn_value",
    "entity_features_join",
    "entity_txn_indicators",
    "benford_mad",
    "risk_matrix",
    "flag_combinations",
    "txn_value_zscore",
    "novelty_country",
    "monthly_volume_zscore",
    "anomaly_profile",
    "isolation_forest",
    "release_wide",
    "benford_ks",
    "vague_description_share",
    "case_indicator_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session("bench", cpus, **{"spark.checkpoint.dir": f"file://{shared}"})
    catalog = queries()
    # One untimed scan starts the JVM's code paths and the file-system caches.
    catalog["scan_lines"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
