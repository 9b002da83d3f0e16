"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from bindings import QUERIES
from isoframe.session import checkpoint_dir, local_session

HEADLINES = [
    "curve_interpolate",
    "curve_sample",
    "curve_raw",
    "resolve_requests",
    "validate_curves",
    "structured_page",
    "keep_first",
    "levels_adopted",
    "final_levels",
    "merge_sources_compare",
    "spectrum_filter",
    "nested_spectrum",
    "experiment_search",
    "experiment_columns",
    "card_gammas",
    "endf_sections",
]


def timed(spark, name, sf):
    started = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"))
    checkpoint_dir(spark)
    seconds = {}
    for name in HEADLINES:
        timed(spark, name, sf)
        seconds[name] = round(timed(spark, name, sf), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
