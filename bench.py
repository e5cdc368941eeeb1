"""Headline benchmark: one JSON line with the wall time of each query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from porespark.plans import catalog  # noqa: E402
from porespark.session import local_session  # noqa: E402

HEADLINE = ("stencil_edges", "edt", "components", "interfaces", "kcl_transport", "streamtubes_topological", "throat_extraction",
            "network_transport", "network_metrics", "topn_overlap", "cross_check", "current_concentration", "run_pointers", "latest_wide")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, app="bench")
    catalog.QUERIES["pore_porosity"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
