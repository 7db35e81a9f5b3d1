"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tempolex.plans import registry
from tempolex.session import local_session

HEADLINE = """snapshot_as_of changes_feed contents_listing corpus_info_rollup asof_citation_lookup validate_versions document_frequency epoch_document_frequency
bm25_coverage_sort bm25_top_k citation_audit citation_verdict_rollup amend_substitute telemetry_summary telemetry_percentiles word_diff act_split
p1_found p2_found p3_found p4_found p5_found p6_found p7_ids p8_found p9_found""".split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    known = registry.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in known]
    known["telemetry_summary"](spark, sf).collect()  # the first query also pays for starting up
    took = {}
    for n in names:
        began = time.time()
        known[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
