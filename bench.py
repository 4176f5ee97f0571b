"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from taxograft.session import local_session
from taxograft.workload import QUERIES
from taxograft.workload.registry import STORED, Inputs

HEADLINE = [
    "edge_catalogue",
    "catalogue_round_trip",
    "contract_parents",
    "depths",
    "subsumes",
    "explode_gold_edges",
    "recompose_splits",
    "context_window",
    "idf_select",
    "bm25",
    "multi_field_search",
    "nearest_exact",
    "enrich_leaf",
    "place_mentions_enriched",
    "recall_any_all_at",
    "auc",
    "parse_prompt",
    "incoming_links",
    "parse_docs_full",
    "person_coref",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    # stored inputs stand for tables that exist before a query runs
    inputs = Inputs(spark, folder)
    t = time.time()
    for name in sorted(STORED):
        getattr(inputs, name)
    setup = time.time() - t
    times: dict[str, float] = {}
    for name in wanted:
        t = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None, "setup_sec": round(setup, 3),
    }))


if __name__ == "__main__":
    main()
