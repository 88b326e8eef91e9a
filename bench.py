"""Headline queries, timed. Prints one JSON line."""

import json
import os
import time

from lexispan.checks import QUERIES, corpus
from lexispan.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "read_nodes", "text_fragments", "neighbour_context", "scope_batches", "translation_units", "unit_candidates",
    "term_statistics", "mined_terms", "corpus_terms", "token_document_frequency", "bm25_ranking", "term_matches",
    "relevant_terms", "injection_log", "alias_families", "pair_checks", "usage_totals", "job_state",
]


def main() -> None:
    spark = local_session(CORES, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["usage_totals"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        # Shared tables are built again, so that every query pays for its whole plan.
        corpus.forget()
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cores": CORES,
            }
        )
    )


if __name__ == "__main__":
    main()
