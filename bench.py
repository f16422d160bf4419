"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one warm-up, then the median of three runs."""

import json
import os
import sys
import time
from statistics import median

from dossier.plans.registry import QUERIES
from dossier.session import session

HEADLINE = ["bm25_topk", "bm25_index_topk", "cosine_topk", "rrf_hybrid_topk", "quality_reasons", "chunk_sections", "chunk_pack_lines", "outline_tree", "anchor_verify", "verbatim_passages", "grep_terms_capped", "content_hash_dups", "digit_mismatch", "coverage_ledger", "timeline_order", "upsert_source", "bare_lines"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(median(runs[1:]), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "seconds over all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
