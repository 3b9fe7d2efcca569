"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. A figure covers building
the query (with the small statistics jobs some operators run) and computing every row of it.
"""

from __future__ import annotations

import json
import os
import time

from topicloom.plans import catalog
from topicloom.session import local_session

HEADLINE = [
    "a01_topic_series", "a02_doc_counts", "a03_topic_averages", "a06_cut_sum", "w01_mass_cut_words", "k03_tree_documents",
    "w02_share", "w03_row_number_events", "w09_stack_wiggle", "w15_layout_size", "w16_tail", "j05_nearest", "a11_box_summary",
    "a12_ohlc_items", "a15_cross_section", "p10_threshold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="topicloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed run, so that the figures do not include starting the engine
    catalog.QUERIES["a01_topic_series"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
